import random
from datetime import datetime, timedelta

import pandas as pd

from graphloom.operators.snapshot_changes import _Block, _chunked, change_counts, chunk_statistics, snapshot_changes, snapshot_pairs
from tests.conftest import tuples

SNAP = "id string, repository_id string, branch_name string, snapshot_metadata map<string,string>, created_at timestamp, pair string"
ART = "id string, snapshot_id string, artifact_type string, qualified_name string, signature string, location string, line_start int, line_end int, source_hash string, sid string, now boolean"
DAY = datetime(2026, 1, 1)


def snap(i, days, repo="r", branch="main", status="READY"):
    return (i, repo, branch, {"status": status} if status else None, DAY + timedelta(days=days) if days is not None else None, "p")


def art(i, s, name, kind="CLASS", sig="", loc="a/b.py:1", end=9, digest="h"):
    return (i, s, kind, name, sig, loc, 1, end, digest, "x", None)


def test_pairs(frame):
    rows = [snap("s2", 2), snap("s1", 1), snap("s1", 1), snap("sf", 3, status="FAILED"), snap("s4", 4), snap("o1", 1, branch="dev"), snap("n", 3, status=None), snap("t", None), snap(None, 9)]
    assert tuples(snapshot_pairs(frame(SNAP, *rows))) == [("s2", "s1"), ("s4", "s2")]


def test_kinds(frame):
    old = [art("1", "s1", "m.a"), art("2", "s1", "m.b"), art("3", "s1", "m.c", sig=None), art("4", "s1", "m.d", loc="x\\y.py:3"), art("5", "s1", "m.e", digest=None), art("6", "s1", "m.f"), art("7", "s1", "m.g"), art("8", "s1", "m.h", end=None), art("9", "s1", None), art("10", "s1", " "), art("1", "s1", "m.a")]
    new = [art("1b", "s2", " m.a "), art("3b", "s2", "m.c", sig=""), art("4b", "s2", "m.d", loc="x/y.py:3"), art("5b", "s2", "m.e", digest="z"), art("6b", "s2", "m.f", digest="z"), art("7b", "s2", "m.g", loc="a/b.py:2"), art("8b", "s2", "m.h", end=1), art("11b", "s2", "m.new"), art("11b", "s2", "m.new")]
    df = snapshot_changes(frame(SNAP, snap("s1", 1), snap("s2", 2)), frame(ART, *old, *new))
    assert tuples(df) == [("s2", "m.b", "removed"), ("s2", "m.f", "changed"), ("s2", "m.g", "changed"), ("s2", "m.h", "changed"), ("s2", "m.new", "added")]
    assert tuples(change_counts(df)) == [("s2", "added", 1), ("s2", "changed", 3), ("s2", "removed", 1)]


def test_empty(frame):
    assert tuples(snapshot_changes(frame(SNAP), frame(ART))) == []
    assert tuples(snapshot_changes(frame(SNAP, snap("s1", 1), snap("s2", 2)), frame(ART))) == []


def test_whole_snapshot_gone(frame):
    df = snapshot_changes(frame(SNAP, snap("s1", 1), snap("s2", 2), snap("s3", 3)), frame(ART, art("1", "s1", "m.a"), art("2", "s3", "m.a")))
    assert tuples(df) == [("s2", "m.a", "removed"), ("s3", "m.a", "added")]


def test_random_against_dictionaries(frame):
    draw = random.Random(3)
    rows, state, expected, last = [], {}, [], None
    for s in range(5):
        state = {n: v for n, v in state.items() if draw.random() > 0.05}
        for n in range(60):
            if draw.random() < 0.1:
                state[f"p{n % 7}.q{n % 3}.f{draw.randrange(90)}"] = draw.randrange(3)
        rows += [art(f"{s}-{n}", f"s{s}", n, end=v) for n, v in state.items() for _ in range(1 + (draw.random() < 0.05))]
        if last is not None:
            expected += [(f"s{s}", n, "added" if n not in last else "removed" if n not in state else "changed") for n in last.keys() | state.keys() if last.get(n) != state.get(n)]
        last = dict(state)
    df = snapshot_changes(frame(SNAP, *(snap(f"s{s}", s) for s in range(5))), frame(ART, *rows))
    assert tuples(df) == sorted(expected, key=repr)


def test_little_changes_are_mostly_discarded(frame):
    """One prefix holds all names; one row of a hundred changes, one comes and one goes."""
    rows = [art(f"a{i}", "s1", f"com.company.f{i:04d}") for i in range(600)]
    rows += [art(f"b{i}", "s2", f"com.company.f{i:04d}", end=9 + (i % 100 == 50)) for i in range(1, 601)]
    rows += [rows[5], rows[5], rows[700]]  # a repeat on one side is no change
    snaps, arts = frame(SNAP, snap("s1", 1), snap("s2", 2)), frame(ART, *rows)
    found = dict(tuples(change_counts(snapshot_changes(snaps, arts)), "change", "n_symbols"))
    assert found == {"added": 1, "removed": 1, "changed": 6}
    assert tuples(snapshot_changes(snaps, arts)) == tuples(snapshot_changes(snaps, arts, mean_rows=1)) == tuples(snapshot_changes(snaps, arts, mean_rows=10**9, max_rows=7))
    ((_, chunks, matched, n, discarded),) = tuples(chunk_statistics(snaps, arts))
    assert n == 600 and discarded > 0.9 * n and matched < chunks
    assert tuples(chunk_statistics(frame(SNAP), frame(ART))) == []


def test_chunks_across_batches():
    """Batches of any size give the same changes as one."""
    draw = random.Random(4)
    rows = [("s", f"n{i:03d}", o, o == 3, draw.getrandbits(62), c, c, h != 0, h, h) for i in range(200) for o in (1, 2, 3) if draw.random() < 0.9 for c, h in [(draw.randrange(2), draw.randrange(3))] for _ in range(1 + (draw.random() < 0.1))]
    hashes = {}
    rows = [(s, n, o, last, hashes.setdefault(n, k), *rest) for s, n, o, last, k, *rest in rows]
    whole = pd.DataFrame(rows, columns=["stream", "name", "ord", "last", "key_hash", "c1", "c2", "hashed", "h1", "h2"])
    once = whole.drop_duplicates(["stream", "name", "ord"])
    state = {(n, o): (c, h) for n, o, c, h in zip(once["name"], once["ord"], once["c1"], once["h1"], strict=True)}
    expected = set()
    for name in set(once["name"]):
        for o in (2, 3):
            now, was = state.get((name, o)), state.get((name, o - 1))
            if now and not was or was and not now:
                expected.add((o, name, "added" if now else "removed"))
            elif now and was and (now[0] != was[0] or now[1] and was[1] and now[1] != was[1]):
                expected.add((o, name, "changed"))
    for step in (1, 3, 50, 10_000):
        parts = [whole.iloc[i : i + step] for i in range(0, len(whole), step)]
        found = pd.concat(_chunked(iter(parts), _Block.changes, 4, 16))
        assert set(zip(found["ord"], found["qualified_name"], found["change"], strict=True)) == expected
        assert len(found) == len(expected)
