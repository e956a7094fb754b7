"""Column -> Column building blocks (text, responses)."""
