"""Files to tables, and results to files."""
