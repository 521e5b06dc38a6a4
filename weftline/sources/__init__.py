"""Readers for the file shapes the engine accepts."""
