"""Graphs from labels, change logs and grids."""
