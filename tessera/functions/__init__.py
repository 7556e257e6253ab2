"""Column functions: format detection, pixels, text, hashes, mathematics."""
