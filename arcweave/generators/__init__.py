"""Graphs made from parameters: classic families, random models, mazes."""
