"""Graphs as text for people and drawing tools."""
