"""From query text to a logical plan of DataFrame operations."""
