"""Relational operators on samples and segments."""
