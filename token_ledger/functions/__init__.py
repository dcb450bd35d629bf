"""Column expressions; nothing here runs Python for a row."""
