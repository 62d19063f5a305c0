"""Plans of the stability engine."""
