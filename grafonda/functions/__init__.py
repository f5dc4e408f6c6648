"""Column builders: orderings of work items, bit functions and seeded hashing."""
