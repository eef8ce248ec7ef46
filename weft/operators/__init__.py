"""Relational operators that Spark has no single call for (extensions, for use in producers)."""
