"""Relational operators from variants to posterior summaries."""
