"""Composite repair plans."""
