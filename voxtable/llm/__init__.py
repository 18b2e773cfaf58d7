"""Operators of a training-data pipeline: scanning, filtering, dedup, tokens and chat rendering."""
