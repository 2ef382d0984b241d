"""Column expressions: text, rules and scores."""
