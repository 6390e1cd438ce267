"""Column expressions: keyed draws, exact bins, ratios, text and time checks."""
