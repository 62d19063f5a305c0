"""Streaming of the stability engine."""
