"""Operators for preparing training text: scoring, deduplication, filtering, formatting and packing."""
