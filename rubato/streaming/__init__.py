"""Streaming of the sequence engine."""
