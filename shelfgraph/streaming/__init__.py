"""Streams of pages into a stored graph."""
