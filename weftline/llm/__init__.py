"""Operators for training-text pipelines.  Nothing outside this package imports it."""
