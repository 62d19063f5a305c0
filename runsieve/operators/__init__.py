"""Operators of the stability engine."""
