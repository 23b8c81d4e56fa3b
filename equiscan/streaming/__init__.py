"""Incremental catch-up: which days are due, and a file stream that upserts what has landed."""
