"""Sources of the stability engine."""
