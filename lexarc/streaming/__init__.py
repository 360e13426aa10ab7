"""Streaming of the transcript engine."""
