"""Streaming forms of the line formats."""
