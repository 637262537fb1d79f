"""Column expressions: names, numbers, classifications and predicates."""
