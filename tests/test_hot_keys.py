from graphloom.operators.hot_keys import hot_key_profile, hot_keys, key_counts
from tests.conftest import tuples

SCHEMA = "id string, source_artifact_id string, target_artifact_id string, relationship_type string, confidence double, _v int, n_edges string"


def edges(frame, *rows):
    return frame(SCHEMA, *((*r, 7, "x") for r in rows))


def test_counts_each_identity_once(frame):
    df = edges(frame, ("e1", "a", "t", "CALLS", 0.5), ("e1", "a", "t", "CALLS", 0.5), ("e2", "a", "t", "CALLS", None), ("e3", None, "t", "CALLS", 1.0), (None, "z", "t", "CALLS", 0.1))
    assert tuples(hot_key_profile(df)) == [("t", "CALLS", 3, 1, 0.75)]


def test_null_keys_form_a_group(frame):
    df = edges(frame, ("e1", "a", None, None, None), ("e2", "b", None, None, None), ("e3", "b", "", "", None))
    assert tuples(hot_key_profile(df)) == [("", "", 1, 1, None), (None, None, 2, 2, None)]


def test_empty(frame):
    assert tuples(hot_key_profile(edges(frame))) == []
    assert tuples(hot_keys(hot_key_profile(edges(frame)))) == []


def test_share_counts_ties(frame):
    df = edges(frame, *((f"e{i}", f"s{i}", "hot" if i < 98 else f"t{i}", "CALLS", 0.25) for i in range(100)))
    assert tuples(hot_keys(hot_key_profile(df), 0.01), "target_artifact_id", "n_edges") == [("hot", 98), ("t98", 1), ("t99", 1)]
    assert tuples(hot_keys(hot_key_profile(df), 0.02), "target_artifact_id") == [("hot",)]


def test_hot_key_with_many_members(frame):
    df = edges(frame, *((f"e{i}", f"s{i % 700}", "hot", "USES", (i % 4) / 4) for i in range(3000)))
    assert tuples(hot_key_profile(df)) == [("hot", "USES", 3000, 700, 0.375)]


def test_counts_alone(frame):
    df = edges(frame, *((f"e{i % 900}", f"s{i % 70}", "hot" if i % 3 else None, "USES", 0.5) for i in range(1800)), (None, "s", "hot", "USES", 1.0))
    assert tuples(key_counts(df)) == tuples(hot_key_profile(df).select("target_artifact_id", "relationship_type", "n_edges"))
    assert tuples(hot_keys(key_counts(edges(frame)))) == []
