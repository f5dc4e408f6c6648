"""Execution-plan helpers: lineage cuts, the fixpoint loop and size checks."""
