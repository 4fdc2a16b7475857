"""Column expressions: text, numbers, identifiers, clock, JSON and payments."""
