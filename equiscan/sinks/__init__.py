"""Table writes, keyed upserts and report exports."""
