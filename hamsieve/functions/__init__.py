"""Column expressions: text cleaning, mark-up removal, byte decoding, ratios."""
