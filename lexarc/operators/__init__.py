"""Operators of the transcript engine."""
