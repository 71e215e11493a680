"""Column helpers and posterior statistics."""
