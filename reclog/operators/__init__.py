"""Operators over record streams."""
