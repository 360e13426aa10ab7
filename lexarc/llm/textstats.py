"""Code-point tables and arrays shared by the statistical text operators."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


@lru_cache(maxsize=1)
def tables() -> dict[str, np.ndarray]:
    """Per code point of the basic plane: letter, upper, digit, space, and printable ASCII that is none of them."""
    chars = [chr(i) for i in range(65536)]
    t = {k: np.fromiter((f(c) for c in chars), dtype=bool, count=65536) for k, f in (
        ("letter", str.isalpha), ("upper", str.isupper), ("digit", str.isdigit), ("space", str.isspace))}
    t["symbol"] = ~(t["letter"] | t["digit"] | t["space"])
    return t


def points(text: str) -> np.ndarray:
    """Code points; those outside the basic plane become one letter or one symbol of it."""
    a = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if len(a) and a.max() > 0xFFFF:
        a = a.copy()
        for i in np.flatnonzero(a > 0xFFFF):
            a[i] = 0x4E00 if chr(a[i]).isalpha() else 0x2603
    return a
