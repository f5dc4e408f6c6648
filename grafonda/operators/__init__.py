"""Graph operators: algebra on vertex and edge tables, kernels and their checks."""
