"""Sources of the transcript engine."""
