"""Operators for preparing training text at scale: sharding, de-duplication, filtering, scoring, extraction and mixing."""
