"""Sources of the sequence engine."""
