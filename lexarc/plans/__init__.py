"""Plans of the transcript engine."""
