"""How alike two field names are, judged by their words and letters alone."""

from __future__ import annotations

import re
from difflib import SequenceMatcher
from functools import lru_cache


@lru_cache(maxsize=65536)
def words(path: str) -> tuple[str, ...]:
    """Lower-case words of a name or dotted path in snake, kebab or camel case."""
    spaced = re.sub(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " ", path)
    return tuple(w for w in re.split(r"[\W_]+", spaced.lower()) if w)


@lru_cache(maxsize=65536)
def similarity(one: str, other: str) -> float:
    """1 for the same words, 0.9 for an initialism, 0.8 for a shortened word, else by shared words or letters."""
    x, y = words(one), words(other)
    if not x or not y:
        return float(one == other)
    if "".join(x) == "".join(y):
        return 1.0
    for short, long in ((x, y), (y, x)):
        if len(short) == 1 and len(long) > 1 and short[0] == "".join(w[0] for w in long):
            return 0.9
        if len(short) == 1 and len(short[0]) >= 3 and len(long) == 1 and long[0].startswith(short[0]):
            return 0.8
    shared = len(set(x) & set(y)) / len(set(x) | set(y))
    letters = SequenceMatcher(None, "".join(x), "".join(y)).ratio()
    return max(shared, letters if letters >= 0.8 else 0.0)
