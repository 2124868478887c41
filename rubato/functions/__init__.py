"""Functions of the sequence engine."""
