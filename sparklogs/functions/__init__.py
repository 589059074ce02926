"""Column functions over log lines, queries and texts."""
