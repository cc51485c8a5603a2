"""Relational operators over many documents or queries at once."""
