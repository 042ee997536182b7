from datetime import datetime, timedelta

from graphloom.operators import impact
from graphloom.operators.graph import nodes
from graphloom.operators.snapshot_changes import snapshot_pairs
from tests.conftest import tuples

SNAP = "id string, repository_id string, branch_name string, snapshot_metadata map<string,string>, created_at timestamp"
ART = "id string, snapshot_id string, artifact_type string, language string, name string, qualified_name string, signature string, location string, line_start int, line_end int, source_hash string"
EDGES = "id string, snapshot_id string, source_artifact_id string, target_artifact_id string, relationship_type string, confidence double"
EXT = "id string, artifact_type string, language string, name string, qualified_name string, location string"


def tables(frame):
    snaps = frame(SNAP, *((s, "r", "main", {"status": "READY"}, datetime(2026, 1, 1) + timedelta(days=i)) for i, s in enumerate(("s1", "s2"))))
    art = lambda i, s, q, kind="FUNCTION", sig=None, end=5, h="h": (i, s, kind, "python", q.split(".")[-1], q, sig, f"m/{q}.py:1", 1, end, h)
    arts = frame(
        ART,
        art("a1", "s1", "m.a"), art("b1", "s1", "m.b"), art("c1", "s1", "m.c"), art("g1", "s1", "m.gone"), art("d1", "s1", "m.caller_of_gone"),
        art("a2", "s2", "m.a", sig=""), art("b2", "s2", "m.b", end=9), art("c2", "s2", "m.c", h="other"), art("n2", "s2", "m.new"), art("t2", "s2", "m.test_b", kind="TEST_CASE"), art("u2", "s2", "m.test_u", kind="TEST_CASE"), art("d2", "s2", "m.caller_of_gone"), art("b2", "s2", "m.b", end=9),
    )
    edge = lambda i, s, a, b, rel: (i, s, a, b, rel, 0.9)
    edges = frame(EDGES, edge("1", "s1", "d1", "g1", "CALLS"), edge("2", "s2", "a2", "b2", "CALLS"), edge("3", "s2", "t2", "a2", "CALLS"), edge("4", "s2", "u2", "d2", "TESTS"), edge("5", "s2", "t2", "d2", "TESTS"))
    return snaps, arts, edges, frame(EXT)


def test_change_set(frame):
    snaps, arts, _, _ = tables(frame)
    rows = tuples(impact.change_set(snaps, arts), "qualified_name", "change_type", "graph", "artifact_id")
    assert rows == [("m.b", "MODIFIED", "s2", "b2"), ("m.c", "MODIFIED", "s2", "c2"), ("m.gone", "REMOVED", "s1", "g1"), ("m.new", "ADDED", "s2", "n2"), ("m.test_b", "ADDED", "s2", "t2"), ("m.test_u", "ADDED", "s2", "u2")]
    assert tuples(impact.change_summary(impact.change_set(snaps, arts)), "added", "removed", "modified") == [(3, 1, 2)]


def test_removed_symbols_use_the_old_graph(frame):
    snaps, arts, edges, ext = tables(frame)
    changed = impact.change_set(snaps, arts)
    found = impact.impact_findings(changed, edges)
    assert tuples(found, "root", "node", "depth", "classification") == [("b2", "a2", 1, "DIRECT"), ("b2", "t2", 2, "PROVEN_TRANSITIVE"), ("g1", "d1", 1, "DIRECT")]
    paths = tuples(impact.impact_paths(found, nodes(arts, ext)), "node", "terminal", "path")
    assert ("t2", "TEST", "b2 > a2 > t2") in paths
    named = tuples(impact.named_findings(found, nodes(arts, ext)), "root_name", "affected_name", "depth", "completeness")
    assert named[0] == ("m.b", "m.a", 1, "COMPLETE") and len(named) == 3
    assert ("b2", "a2") not in tuples(impact.impact_findings(changed, edges, left_out=frame("node string", ("a2",))), "root", "node")
    summary = impact.impact_summary(changed, found, nodes(arts, ext)).first()
    assert (summary.changed, summary.direct, summary.indirect, summary.unique_affected, summary.n_test) == (6, 2, 1, 3, 1)


def test_tests_to_run(frame):
    snaps, arts, edges, ext = tables(frame)
    changed = impact.change_set(snaps, arts).where("change_type = 'MODIFIED'")
    affected = impact.affected_tests(changed, edges, nodes(arts, ext))
    assert tuples(affected, "test_id", "depth", "impact", "provenance") == [("t2", 2, "INDIRECT", "INFERRED")]
    rest = impact.unaffected_tests(affected, snapshot_pairs(snaps), arts, edges)
    assert tuples(rest, "test_id") == [("u2",)]
    assert tuples(impact.test_selection(affected, rest), "to_run", "to_skip", "skip_share") == [(1, 1, 0.5)]


def test_blast_radius_and_baselines(frame):
    snaps, arts, edges, ext = tables(frame)
    changed = impact.change_set(snaps, arts)
    blast = impact.blast_radius(changed.where("artifact_id = 'b2'").selectExpr("graph", "artifact_id as root"), edges, nodes(arts, ext))
    assert tuples(blast, "root", "components", "tests", "score", "risk") == [("b2", 1, 1, 13, "LOW")]
    assert len([r for r in tuples(impact.one_hop_baselines(changed, edges), "baseline", "node") if r[0] == "calls"]) == 8
    assert tuples(impact.mutations_of(changed.where("change_type = 'REMOVED'")), "mutation_type") == [("REMOVE_COMPONENT",)]


def test_empty(frame):
    none = impact.change_set(frame(SNAP), frame(ART))
    assert tuples(none) == [] and tuples(impact.impact_findings(none, frame(EDGES))) == []
    assert tuples(impact.impact_summary(none, impact.impact_findings(none, frame(EDGES)), nodes(frame(ART), frame(EXT)))) == []
