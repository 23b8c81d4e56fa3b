"""Equity screening and portfolio analytics as PySpark DataFrame jobs."""
