"""Vectorised 64-bit hashes of the words of a text."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _byte_tables():
    rng = np.random.default_rng(11)
    values = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
    word = np.ones(256, bool)
    word[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
    return values, word


@lru_cache(maxsize=1)
def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.concatenate(([_U(1)], np.full(n - 1, 0x9E3779B97F4A7C15, dtype=np.uint64))))


def word_hashes(text: str, fold_case: bool = True) -> np.ndarray:
    """64-bit hashes of the words `[^\\x20\\x09-\\x0D]+` in order; fold_case lower-cases A-Z."""
    values, is_word = _byte_tables()
    data = text.encode("utf-8", "surrogatepass")
    raw = np.frombuffer(data.lower() if fold_case else data, dtype=np.uint8)
    mask = is_word[raw]
    edge = np.diff(np.concatenate(([0], mask.view(np.int8), [0])))
    lengths = np.flatnonzero(edge == -1) - np.flatnonzero(edge == 1)
    if not len(lengths):
        return np.zeros(0, dtype=np.uint64)
    begin = np.cumsum(lengths) - lengths
    body = raw[mask]
    place = np.arange(len(body)) - np.repeat(begin, lengths)
    power = _powers(1 << max(12, int(lengths.max()).bit_length()))
    return _mix(np.add.reduceat(values[body] * power[place], begin) + lengths.astype(np.uint64))
