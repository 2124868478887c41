"""Plans of the sequence engine."""
