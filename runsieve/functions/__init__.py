"""Functions of the stability engine."""
