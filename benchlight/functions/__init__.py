"""Column helpers: units, formulas, text."""
