from datetime import datetime as D

from graphloom.operators.references import dangling_references, deltas, merged_state, orphan_report, orphans
from tests.conftest import tuples

T = [D(2026, m, 1) for m in range(1, 7)]
SCHEMAS = {
    "edges": "id string, snapshot_id string, target_artifact_id string, k string, s string",
    "links": "id string, target_id string, target_type string, created_at timestamp, kind string",
    "incidents": "id string, evidence_ids array<string>, created_at timestamp",
    "artifacts": "id string, snapshot_id string, k int",
    "external": "id string",
    "snapshots": "id string, created_at timestamp",
    "events": "event_id string, ingested_at timestamp",
}


def found(frame, **rows):
    return dangling_references(*(frame(s, *rows.get(n, [])) for n, s in SCHEMAS.items()))


SNAPSHOTS = [("s1", T[0]), ("s2", T[1]), ("s3", T[2]), ("s3", T[2]), ("sx", None)]
ARTIFACTS = [("a1", "s1", 1), ("A2 ", "s2", 1), ("a3", "s3", 1), ("a4", "s1", 1), ("a4", "s3", 1), ("a5", "sx", 1), (None, "s1", 1), ("", "s1", 1)]


def test_edges(frame):
    edges = [("e1", "s2", "a1"), ("e2", "s2", " a2\t"), ("e3", "s2", "A3"), ("e4", "s2", "zz"), ("e5", "s2", ""), ("e6", "s2", None), ("e7", "s2", "EXT1"), ("e4", "s2", "zz"), ("e8", "s2", "a4"), ("e9", "s2", "a5"), ("ea", None, "a1")]
    df = found(frame, edges=[(*e, "x", "y") for e in edges], artifacts=ARTIFACTS, external=[("ext1",), (None,)], snapshots=SNAPSHOTS)
    assert tuples(df.drop("period_at")) == [("edges", "e1", "a1", "deleted"), ("edges", "e3", "a3", "late"), ("edges", "e4", "zz", "missing"), ("edges", "e8", "a4", "deleted"), ("edges", "e9", "a5", "deleted"), ("edges", "ea", "a1", "deleted")]


def test_links_and_evidence(frame):
    links = [("l1", "a1", "artifact", T[3], ""), ("l2", "nope", "artifact", T[3], ""), ("l3", "EV1", "runtime_event", T[3], ""), ("l4", "ev2", "runtime_event", T[3], ""), ("l5", "ev9 ", "runtime_event", T[3], ""), ("l6", None, "artifact", None, ""), ("l7", "ev2", "runtime_event", None, "")]
    incidents = [("i1", ["ev1", "ev2", "ev2", "EV9", "", None], T[3]), ("i2", None, T[3]), ("i3", [], T[3]), ("i4", ["ev3"], T[3])]
    events = [("ev1", T[4]), ("ev1", T[2]), ("Ev2", T[5]), ("ev3", None)]
    df = found(frame, links=links, incidents=incidents, events=events, artifacts=ARTIFACTS, external=[], snapshots=SNAPSHOTS)
    assert tuples(df.drop("period_at")) == [("incident_links", "l2", "nope", "missing"), ("incident_links", "l4", "ev2", "late"), ("incident_links", "l5", "ev9", "missing"), ("incidents", "i1", "ev2", "late"), ("incidents", "i1", "ev9", "missing")]
    assert tuples(orphan_report(df)) == [("incident_links", "2026-04", "late", 1, 1), ("incident_links", "2026-04", "missing", 2, 2), ("incidents", "2026-04", "late", 1, 1), ("incidents", "2026-04", "missing", 1, 1)]


def test_empty(frame):
    assert tuples(found(frame)) == []
    assert tuples(found(frame, edges=[("e", "s", "a", "", "")]).drop("period_at")) == [("edges", "e", "a", "missing")]


def test_hot_missing_key(frame):
    df = found(frame, edges=[(f"e{i}", "s1", "gone" if i % 3 else f"a{i}", "", "") for i in range(3000)], snapshots=SNAPSHOTS)
    assert df.count() == 3000


def test_state_follows_deltas(frame):
    rows = frame("k string", ("a",), ("a",), ("b",), (None,))
    state = merged_state([deltas(rows, ["k"], references=1), deltas(frame("k string", ("a",)), ["k"], existence=1)], ["k"])
    assert tuples(state) == [("a", 2, 1), ("b", 1, 0)]
    assert tuples(orphans(state), "k") == [("b",)]
    later = merged_state([state, deltas(frame("k string", ("a",)), ["k"], existence=-1), deltas(frame("k string", ("b",)), ["k"], references=-1)], ["k"])
    assert tuples(later) == [("a", 2, 0)]
    assert tuples(orphans(later), "k") == [("a",)]
