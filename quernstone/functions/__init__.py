"""Column expressions: text normalisation, SQL-text features, rounding and scalar helpers."""
