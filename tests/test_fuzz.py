from datetime import datetime, timedelta, timezone

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from graphloom.functions.names import similarity, words
from graphloom.functions.timestamps import instants
from graphloom.functions.trees import assignment
from graphloom.functions.zones import tables
from graphloom.operators.schema_drift import Field, edit_script, kind, leaves, parse_line

ZONES = tables(["UTC", "Europe/Berlin"])
JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=8), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=5), x, max_size=4), max_leaves=12)


@given(st.lists(st.none() | st.text(max_size=40) | st.from_regex(r"\d{1,4}[-/.]\d{1,2}[-/.]\d{1,4}[ T]\d{1,2}:\d\d(:\d\d)?([.,]\d{1,9})?( ?[+-]\d\d:?\d\d| ?[A-Z]{1,4})?", fullmatch=True), max_size=20))
@settings(max_examples=200, deadline=None)
def test_any_text_has_an_instant_or_none(texts):
    n = len(texts)
    out = instants(pd.Series(texts, dtype=object), pd.Series(["Europe/Berlin"] * n, dtype=object), pd.Series([True] * n, dtype=object), ZONES)
    assert len(out) == n


@given(st.datetimes(datetime(1971, 1, 1), datetime(2090, 1, 1)), st.integers(-840, 840), st.sampled_from(["%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S,%f"]))
@settings(max_examples=200, deadline=None)
def test_written_offsets_round_trip(moment, minutes, form):
    zone = timezone(timedelta(minutes=minutes))
    sign, rest = "-" if minutes < 0 else "+", abs(minutes)
    text = moment.strftime(form) + f"{sign}{rest // 60:02d}:{rest % 60:02d}"
    out = instants(pd.Series([text]), pd.Series([None], dtype=object), pd.Series([None], dtype=object), ZONES)
    expected = (moment.replace(tzinfo=zone) - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)
    assert int(out[0]) == expected


@given(JSON)
@settings(max_examples=200, deadline=None)
def test_any_tree_has_leaves(tree):
    if isinstance(tree, dict):
        for path, value in leaves(tree):
            assert isinstance(path, str) and value is not None and kind(value) in {"string", "number", "boolean", "list"}


@given(st.text(max_size=60))
def test_any_line_is_read_or_not(line):
    assert parse_line(line) is None or isinstance(parse_line(line), dict)


PATHS = st.lists(st.text(alphabet="abxy_", min_size=1, max_size=3), min_size=1, max_size=3).map("\x1f".join)
SCHEMA = st.dictionaries(PATHS, st.sampled_from(["string", "number", "list"]), max_size=7)


@given(SCHEMA, SCHEMA)
@settings(max_examples=200, deadline=None)
def test_scripts_account_for_every_field(old, new):
    fields = lambda schema: {p: Field(k, {len(p)}) for p, k in schema.items()}
    script = [(o, a, b) for o, node, a, b in edit_script(fields(old), fields(new)) if node == "field"]
    renamed = {(a, b) for o, a, b in script if o in ("rename", "move", "carry")}
    assert len({a for a, _ in renamed}) == len(renamed) == len({b for _, b in renamed})
    assert {b for o, _, b in script if o == "add"} | {b for _, b in renamed} == new.keys() - old.keys()
    assert {a for o, a, _ in script if o == "delete"} | {a for a, _ in renamed} == old.keys() - new.keys()
    assert {b for o, _, b in script if o == "retype"} == {n for n in new if n in old and old[n] != new[n]} | {b for a, b in renamed if old[a] != new[b]}


@given(st.integers(1, 5), st.integers(1, 5), st.randoms(use_true_random=False))
@settings(max_examples=100, deadline=None)
def test_matching_is_the_cheapest(rows, columns, draw):
    from itertools import permutations

    cost = np.array([[draw.random() for _ in range(columns)] for _ in range(rows)])
    small, large = sorted((rows, columns))
    flat = cost if rows <= columns else cost.T
    best = min(sum(flat[i, p[i]] for i in range(small)) for p in permutations(range(large), small))
    pairs = assignment(cost)
    assert len(pairs) == small and abs(sum(cost[i, j] for i, j in pairs) - best) < 1e-9


@given(st.text(max_size=30), st.text(max_size=30))
def test_names(one, other):
    assert 0 <= similarity(one, other) <= 1 and similarity(one, one) == 1 and isinstance(words(one), tuple)
