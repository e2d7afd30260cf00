"""Streaming reads and writes."""
