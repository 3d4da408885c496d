"""Incremental detection."""
