"""lexarc: a PySpark-native analytics engine for paginated, speaker-attributed transcripts."""
