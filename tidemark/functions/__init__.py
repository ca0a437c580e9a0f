"""Column expressions: calendar, scores, text, display."""
