"""Column expressions: rounding, listing features, money, labels, similarity."""
