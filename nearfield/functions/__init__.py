"""Column functions: distances and hashes."""
