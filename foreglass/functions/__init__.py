"""Column expressions on text, replies, dates and vectors."""
