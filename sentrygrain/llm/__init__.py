"""Operators of a large training-data pipeline."""
