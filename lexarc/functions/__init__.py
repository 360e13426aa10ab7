"""Functions of the transcript engine."""
