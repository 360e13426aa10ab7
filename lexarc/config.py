"""Settings of the engine, read on the driver only."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """The thresholds that results depend on."""

    chunk_chars: int = 1800
    chunk_max_units: int = 6
    continue_similarity: float = 0.18
    related_similarity: float = 0.32
    max_pages_continue: int = 8
    recurrence_gap_pages: int = 4
    min_topic_chars: int = 350
    merge_below_chars: int = 6000
    max_topic_pages: int = 10
    segment_vocabulary: int = 8000
    phrase_vocabulary: int = 4000
    evidence_chars: int = 420
    search_results: int = 8
    deposition_name: str = "Deposition"
    decision_provider: str = ""
    temperature: float = 0.0

    @classmethod
    def from_env(cls, env=os.environ) -> EngineConfig:
        """Zero and empty values mean the default."""
        known = {"LEXARC_CHUNK_CHARS": ("chunk_chars", int), "LEXARC_CHUNK_MAX_UNITS": ("chunk_max_units", int), "LEXARC_DEPOSITION_NAME": ("deposition_name", str),
                 "LEXARC_DECISION_PROVIDER": ("decision_provider", str), "LEXARC_TEMPERATURE": ("temperature", float)}
        given = {field: kind(env[key]) for key, (field, kind) in known.items() if env.get(key)}
        return cls(**{k: v for k, v in given.items() if v})
