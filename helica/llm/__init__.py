"""Operators that prepare text and items for training large language models."""
