"""Operators of the sequence engine."""
