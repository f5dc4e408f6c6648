"""Incremental maintenance of results over streams of arcs."""
