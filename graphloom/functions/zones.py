"""Versioned zone transition tables for vectorised conversion of local times.

A table holds, per zone, the local wall-clock boundaries at which another offset begins to
count, and the offsets. The boundaries follow one rule for both kinds of change: at an instant
``t`` where the offset goes from ``a`` to ``b`` the new offset counts from wall time ``t + max(a, b)``. So a
time that occurs twice means the first, and one that was skipped is read with the offset in
force before the change.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, ZoneInfoNotFoundError

import numpy as np

#: Years that tables hold; rarer ones are looked up one by one.
FIRST_YEAR, LAST_YEAR = 1970, 2100
_FIRST, _LAST = (int(datetime(y, 1, 3, tzinfo=timezone.utc).timestamp()) for y in (FIRST_YEAR, LAST_YEAR - 1))


def version() -> str:
    """Version of the zone data behind the tables."""
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ImportError:
        return "system"


@lru_cache(maxsize=None)
def transitions(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    """``(wall boundaries, offsets)`` in seconds, offsets one longer; None if there is no such zone.

    For times near or outside the ends of the table see ``to_utc``.
    """
    try:
        zone = ZoneInfo(name)
    except (ZoneInfoNotFoundError, ValueError, OSError):
        return None
    offset = lambda s: int(datetime.fromtimestamp(s, timezone.utc).astimezone(zone).utcoffset().total_seconds())
    start = int(datetime(FIRST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp())
    end = int(datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp())
    day = int(timedelta(days=1).total_seconds())
    offsets, walls = [offset(start)], []
    for s in range(start, end, day):
        now = offset(s + day)
        if now != offsets[-1]:
            low, high = s, s + day
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == offsets[-1] else (low, middle)
            walls.append(high + max(offsets[-1], now))
            offsets.append(now)
    return np.array(walls, dtype=np.int64), np.array(offsets, dtype=np.int64)


class Table(tuple):
    """``(wall boundaries, offsets)`` of a zone, with its name."""

    name: str


def tables(names: list[str]) -> dict[str, Table]:
    """Tables of those names that are zones."""
    out = {}
    for n in sorted(set(names)):
        if n and (t := transitions(n)) is not None:
            out[n] = Table(t)
            out[n].name = n
    return out


def _rare(wall: int, zone: ZoneInfo) -> int:
    """UTC seconds of a wall time of any year: the first of two, and the offset before the change for a skipped one."""
    try:
        local = datetime(1970, 1, 1) + timedelta(seconds=wall)
        return wall - int(local.replace(tzinfo=zone, fold=0).utcoffset().total_seconds())
    except OverflowError:
        return wall


def to_utc(wall: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """UTC seconds of wall-clock seconds; distinct times outside the table's years are looked up in the zone itself."""
    walls, offsets = table
    out = wall - offsets[np.searchsorted(walls, wall, side="right")]
    outside = (wall < _FIRST) | (wall >= _LAST)
    if outside.any() and isinstance(table, Table):
        zone = ZoneInfo(table.name)
        distinct, where = np.unique(wall[outside], return_inverse=True)
        out[outside] = np.array([_rare(int(w), zone) for w in distinct], dtype=np.int64)[where.ravel()]
    return out
