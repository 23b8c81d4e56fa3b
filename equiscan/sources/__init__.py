"""Readers for landed files and stored tables, and the tables derived from the generic test data."""
