"""Permanent, append-only record streams on Spark DataFrames."""
