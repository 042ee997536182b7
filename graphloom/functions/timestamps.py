"""Timestamps of many notations to microseconds since 1970 UTC.

Each text is tokenised into a shape mask of the same length (``d`` digit, ``a`` letter, other
characters as they are). A mask is matched against the notations once and gives a recipe: the
slices at which year, month and so on stand. All texts of one mask are then cut and converted
together with array arithmetic; local times go through zone transition tables.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd

#: Zone abbreviations and their offsets in minutes.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180, "msk": 180,
    "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
    "brt": -180, "brst": -120, "art": -180, "ist": 330, "npt": 345, "pkt": 300, "sgt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540,
    "acst": 570, "acdt": 630, "aest": 600, "aedt": 660, "nzst": 720, "nzdt": 780,
}
#: Month and weekday names.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
MONTH_NUMBER = {n: i + 1 for i, m in enumerate(MONTHS) for n in (m, m[:3])} | {"sept": 9}
WEEKDAY_NAMES = {n for d in WEEKDAYS for n in (d, d[:3])}

_CLASSES = {i: " " for i in (9, 10, 11, 12, 13, 32, 160)} | {i: "d" for i in range(48, 58)} | {i: "a" for i in (*range(65, 91), *range(97, 123))}
_ZONE = r"(?: *(?P<sign>[+-])(?P<zh>dd)(?::?(?P<zm>dd))?(?:\[[a/_+d-]+\])?| *(?P<zone>a{1,5}))?"
_TIME = r"(?P<H>dd?):(?P<M>dd)(?::(?P<S>dd)(?:[.,](?P<f>d+))?)?"
_NOTATIONS = [
    re.compile(p)
    for p in (
        rf"(?P<Y>dddd)-(?P<m>dd)-(?P<D>dd)(?P<t>[a ]) *{_TIME}{_ZONE}",
        rf"(?P<Y>dddd)/(?P<m>dd)/(?P<D>dd)(?P<t>[a ]) *{_TIME}{_ZONE}",
        rf"(?P<Y>dddd)(?P<m>dd)(?P<D>dd)(?P<t>[a ])(?P<H>dd)(?P<M>dd)(?P<S>dd)(?:[.,](?P<f>d+))?{_ZONE}",
        rf"(?P<n1>dd?)(?P<sep>[./-])(?P<n2>dd?)(?P=sep)(?P<Y>dddd),? +{_TIME}(?: *(?P<half>aa))?(?: *(?P<sign>[+-])(?P<zh>dd):?(?P<zm>dd)| +(?P<zone>a{{3,5}}))?",
        rf"(?P<D>dd?)/(?P<mon>aaa)/(?P<Y>dddd):{_TIME}{_ZONE}",
        rf"(?:(?P<wd>a{{3,9}}),? +)?(?P<D>dd?)[ -](?P<mon>a{{3,9}})[ -](?P<Y>dddd),? +{_TIME}{_ZONE}",
        rf"(?:(?P<wd>a{{3,9}}),? +)?(?P<mon>a{{3,9}}) +(?P<D>dd?),? +(?P<Y>dddd),? +{_TIME}(?: *(?P<half>aa))?(?: *(?P<sign>[+-])(?P<zh>dd):?(?P<zm>dd)| +(?P<zone>a{{3,5}}))?",
        r"(?P<e0>d{10})(?:[.](?P<f>d+))?",
        r"(?P<e3>d{13})",
        r"(?P<e6>d{16})",
        r"(?P<e9>d{19})",
    )
]


def mask(text: str) -> str:
    """The shape of a text, character by character."""
    return text.translate(_CLASSES)


def recipe(shape: str) -> dict[str, tuple[int, int]] | None:
    """Slices of the parts of a notation, or None for a shape that is none. Only short shapes, which come again, are remembered."""
    return _recipe(shape) if len(shape) <= 80 else _recipe.__wrapped__(shape)


@lru_cache(maxsize=4096)
def _recipe(shape: str) -> dict[str, tuple[int, int]] | None:
    for notation in _NOTATIONS:
        if found := notation.fullmatch(shape):
            return {k: found.span(k) for k, v in found.groupdict().items() if v is not None}
    return None


def _words(codes: np.ndarray, span: tuple[int, int], known: dict[str, int], absent: int) -> np.ndarray:
    part = np.ascontiguousarray(codes[:, span[0] : span[1]]).view(f"U{span[1] - span[0]}").ravel()
    names, where = np.unique(part, return_inverse=True)
    return np.array([known.get(str(n).strip().lower(), absent) for n in names], dtype=np.int64)[where.ravel()]


def _convert(texts: list[str], parts: dict[str, tuple[int, int]], zone: np.ndarray, day_first: np.ndarray, tables: list) -> np.ndarray:
    """Microseconds of texts of one shape, the least integer where there is none.

    ``zone``: index into ``tables`` or -1; ``day_first``: 1, 0 or -1 for unknown.
    """
    absent = np.iinfo(np.int64).min
    width = len(texts[0])
    codes = np.array(texts, dtype=f"U{width}").view(np.uint32).reshape(len(texts), width)
    def number(name: str, default: int = 0) -> np.ndarray:
        if name not in parts:
            return np.full(len(texts), default, dtype=np.int64)
        low, high = parts[name]
        out = np.zeros(len(texts), dtype=np.int64)
        for i in range(low, high):
            out = out * 10 + codes[:, i].astype(np.int64) - 48
        return out

    micros = np.zeros(len(texts), dtype=np.int64)
    if "f" in parts:
        low, high = parts["f"]
        for i in range(6):
            micros = micros * 10 + (codes[:, low + i].astype(np.int64) - 48 if low + i < high else 0)
    if "e0" in parts:
        return number("e0") * 1_000_000 + micros
    if "e3" in parts:
        return number("e3") * 1_000
    if "e6" in parts:
        return number("e6")
    if "e9" in parts:
        # 19 digits may exceed 63 bits, so the last three are cut off first
        parts = {"x": (parts["e9"][0], parts["e9"][1] - 3)}
        return number("x")
    ok = np.ones(len(texts), dtype=bool)
    if "t" in parts:
        ok &= np.isin(codes[:, parts["t"][0]], [ord(c) for c in "Tt "])
    if "n1" in parts:
        first, second = number("n1"), number("n2")
        ok &= day_first >= 0
        month, day = np.where(day_first == 1, second, first), np.where(day_first == 1, first, second)
    else:
        day = number("D")
        month = _words(codes, parts["mon"], MONTH_NUMBER, 0) if "mon" in parts else number("m")
    if "wd" in parts:
        ok &= _words(codes, parts["wd"], dict.fromkeys(WEEKDAY_NAMES, 1), 0) == 1
    year, hour, minute, second = number("Y"), number("H"), number("M"), number("S")
    if "half" in parts:
        half = _words(codes, parts["half"], {"am": 0, "pm": 12}, -1)
        ok &= (half >= 0) & (hour >= 1) & (hour <= 12)
        hour = hour % 12 + np.maximum(half, 0)
    ok &= (month >= 1) & (month <= 12) & (day >= 1) & (hour < 24) & (minute < 60) & (second < 60) & (year >= 1)
    months = (year - 1970) * 12 + np.clip(month, 1, 12) - 1
    starts = months.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    ends = (months + 1).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
    ok &= day <= ends - starts
    wall = (starts + day - 1) * 86_400 + hour * 3_600 + minute * 60 + second
    if "zh" in parts:
        zh, zm = number("zh"), number("zm")
        ok &= (zh <= 18) & (zm < 60)
        sign = np.where(codes[:, parts["sign"][0]] == ord("-"), -1, 1)
        instant = wall - sign * (zh * 3_600 + zm * 60)
    elif "zone" in parts:
        unknown = 10**6
        minutes = _words(codes, parts["zone"], ABBREVIATIONS, unknown)
        ok &= minutes != unknown
        instant = wall - minutes * 60
    else:
        from graphloom.functions.zones import to_utc

        ok &= zone >= 0
        instant = wall.copy()
        for z in np.unique(zone[zone >= 0]):
            at = zone == z
            instant[at] = to_utc(wall[at], tables[z])
    return np.where(ok, instant * 1_000_000 + micros, absent)


def instants(texts: pd.Series, zones: pd.Series, day_first: pd.Series, tables: dict) -> pd.Series:
    """Microseconds since 1970 UTC, null where a text cannot be fixed in time."""
    names = list(tables)
    index = {n: i for i, n in enumerate(names)}
    table = [tables[n] for n in names]
    clean = [t.strip() if isinstance(t, str) else "" for t in texts]
    shapes, distinct = pd.factorize(np.array([mask(t) for t in clean], dtype=object))
    zone = zones.map(index).fillna(-1).to_numpy(dtype=np.int64)
    first = np.array([-1 if f is None or f != f else int(f) for f in day_first], dtype=np.int64)
    absent = np.iinfo(np.int64).min
    out = np.full(len(clean), absent, dtype=np.int64)
    order = np.argsort(shapes, kind="stable")
    bounds = np.searchsorted(shapes[order], np.arange(len(distinct) + 1))
    for i, shape in enumerate(distinct):
        parts = recipe(shape)
        if parts is not None:
            at = order[bounds[i] : bounds[i + 1]]
            out[at] = _convert([clean[j] for j in at], parts, zone[at], first[at], table)
    return pd.Series(pd.arrays.IntegerArray(out, out == absent))
