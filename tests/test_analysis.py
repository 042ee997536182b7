from datetime import datetime, timedelta

import pytest

from pyspark.sql import functions as F

from graphloom.operators import analysis
from tests.conftest import tuples

ART = "id string, snapshot_id string, artifact_type string, language string, name string, qualified_name string, signature string, location string, line_start int, line_end int, source_hash string"
EDGES = "id string, snapshot_id string, source_artifact_id string, target_artifact_id string, relationship_type string, confidence double"
EXT = "id string, artifact_type string, language string, name string, qualified_name string, location string"
SNAP = "id string, repository_id string, branch_name string, commit_hash string, snapshot_metadata map<string,string>, created_at timestamp"


def snap(i, day, repo="r", status="READY", commit=None):
    return (i, repo, "main", commit or i, {"status": status}, datetime(2026, 1, day))


def art(i, s, q, end=5):
    return (i, s, "METHOD", "python", q, f"m.{q}", None, f"m/{q}.py:1", 1, end, None)


def test_statuses(frame):
    arts = frame(ART, art("a1", "s1", "a"), art("b1", "s1", "b"), art("a2", "s2", "a"), art("b2", "s2", "b"), art("a3", "s3", "a"), art("b3", "s3", "b", end=9), art("a4", "s4", "a", end=7), art("b4", "s4", "b", end=9))
    edges = frame(EDGES, ("1", "s3", "a3", "b3", "CALLS", 1.0), ("2", "s4", "a4", "b4", "CALLS", 1.0))
    out = analysis.analyze(frame(SNAP, *(snap(f"s{i}", i) for i in range(1, 5))), arts, edges, frame(EXT))
    assert tuples(out["summary"], "pair", "changed", "unique_affected", "status") == [("s2", 0, 0, "VERIFIED_ZERO"), ("s3", 1, 1, "DETECTED"), ("s4", 1, 0, "CONTAINED")]
    assert tuples(out["paths"], "path") == [("b3 > a3",)]


def test_guardrail_of_long_cycles(frame):
    names = "abcde"
    arts = frame(ART, *(art(f"{s}_{n}", s, n) for s in ("s1", "s2") for n in names), art("t", "s1", "test_a"))
    rows = [(f"{n}{m}", "s1", f"s1_{n}", f"s1_{m}", "CALLS", 1.0) for n, m in zip(names, names[1:] + names[:1], strict=True)]
    rows += [(f"x{n}", "s2", f"s2_{n}", f"s2_{m}", "CALLS", 1.0) for n, m in zip(names, names[1:], strict=False)]
    rails = analysis.guardrails(arts, frame(EDGES, *rows), arts.select("id", "artifact_type", "language", "name", "qualified_name", "location", "snapshot_id"), None)
    assert tuples(rails.where("guardrail = 'CYCLES'")) == [("s1", "CYCLES", "VIOLATION", 1)]
    assert tuples(analysis.architecture_factors(rails.where("guardrail = 'CYCLES'"))) == [("s1", 80.0)]


def test_callers_of_any_depth(frame):
    names = [f"n{i:02d}" for i in range(12)]
    arts = frame(ART, *(art(n, "s", n) for n in names)).select("id", "artifact_type")
    calls = frame(EDGES, *((f"e{i}", "s", b, a, "CALLS", 1.0) for i, (a, b) in enumerate(zip(names, names[1:], strict=False))))
    assert tuples(analysis.caller_scores(frame("graph string, root string", ("s", "n00")), calls, arts), "callers", "score") == [(11, 60)]


def test_preconditions(frame):
    snaps = frame(SNAP, snap("a", 1), snap("b", 2), snap("f", 3, status="FAILED"), snap("o", 4, repo="q"), snap("c", 5, commit="a"))
    pairs = frame("base_id string, target_id string", ("a", "b"), ("a", "f"), ("a", "o"), ("a", "c"), ("a", "zz"))
    assert tuples(analysis.preconditions(pairs, snaps), "target_id", "verdict") == [("b", "OK"), ("c", "SAME_COMMIT"), ("f", "NOT_READY"), ("o", "DIFFERENT_REPOSITORY"), ("zz", "UNKNOWN_SNAPSHOT")]


def test_live_impact(frame):
    arts = frame(ART, art("a", "s", "a"), art("b", "s", "b"), art("c", "s", "c"), art("x", "t", "b"))
    edges = frame(EDGES, ("1", "s", "a", "b", "CALLS", 1.0), ("2", "s", "c", "a", "IMPORTS", 1.0), ("3", "t", "x", "b", "CALLS", 1.0))
    files = frame("change_type string, path string, old_path string", ("MODIFIED", "m/b.py", None), ("ADDED", "new.py", None))
    rows = analysis.live_impact(files, frame("path string, first_line int, last_line int", ("m/b.py", 2, 2)), arts, edges, "s")
    assert tuples(rows) == [("b", "a", 1), ("b", "c", 2)]


def test_scenarios(frame):
    case = "case_id string, entity string"
    rows = analysis.scenario_verdicts(frame(case, ("c", "shop.cart.add"), ("c", "shop.cart.add"), ("d", "x")), frame(case, ("c", "cart.add"), ("d", "y")), frame(case, ("c", "billing"), ("d", "x"), ("e", "q")))
    assert tuples(rows, "case_id", "expected_hit", "excluded_hit", "passed") == [("c", 1, 0, True), ("d", 0, 1, False), ("e", 0, 0, True)]
    labels = analysis.label_set(frame("case_id string, direct array<string>, indirect array<string>, tests array<string>", ("c", ["a", "a", None], None, ["t"])))
    assert tuples(labels) == [("c", "DIRECT", "a"), ("c", "TESTS", "t")]


def test_plans(frame):
    texts = [("1", 'Remove "PaymentService" now'), ("2", "What if traffic doubles on cart.py"), ("3", "Connect it to shop.models"), ("4", "please change something"), ("5", None), ("6", "rename OrderHandler")]
    rows = tuples(analysis.scenario_plans(frame("ident string, text string", *texts)))
    assert rows == [("1", "REMOVE_COMPONENT", "PaymentService", "PLANNED"), ("2", "CAPACITY_LOAD_SPIKE", "cart.py", "NOT_EVALUATED"), ("3", "ADD_DEPENDENCY", "shop.models", "PLANNED"), ("4", "MODIFY_SYMBOL", None, "UNRESOLVED"), ("6", "MODIFY_SYMBOL", "OrderHandler", "PLANNED")]


def test_small_parts(frame):
    df = frame("t string", ("calls",), ("NEW",), (None,))
    assert tuples(df.select(analysis.rule_of(F.col("t")), analysis.analyzer_of(F.col("t")))) == sorted([("RULE_CALLS_CALLER_IMPACT", None), ("RULE_NEW", None), (None, None)], key=repr)
    factors = frame("pair string, factor string, score double", ("p", "TEST_IMPACT", 10.0), ("p", "UNKNOWN_EVIDENCE", 5.0), ("p", "IMPACT_BREADTH", 50.0), ("p", "ARCHITECTURE", 80.0), ("p", "INCIDENT_HISTORY", 60.0))
    assert tuples(analysis.factor_buckets(factors)) == [("p", "guardrails", 80.0), ("p", "incidents", 60.0), ("p", "structure", 50.0), ("p", "tests", 15.0)]
    report = analysis.markdown(frame("pair string, changed int, direct int, indirect int, n_test int, n_api int, max_depth int", ("p", 1, 2, 3, 4, 5, 6))).first().report
    assert report.splitlines()[0] == "# Impact of p" and report.endswith("deepest path: 6")
    rows = frame("snapshot_id string, repository_id string", ("s", "r"), ("t", "q"), (None, None))
    assert analysis.snapshot_rows(rows, "s").count() == analysis.scoped(rows, ["q"]).count() == 1


def test_nine_factors(frame):
    day = datetime(2026, 1, 1)
    relevant = frame("pair string, node string", ("p", "a"), ("p", "b"), ("q", "a"), ("r", "z"))
    event = "event_id string, component_artifact_id string, severity string, environment string, ingested_at timestamp"
    rows = [(f"e{i}", "a", "INFO", "staging", day + timedelta(hours=i)) for i in range(60)] + [("old", "a", "ERROR", "staging", day - timedelta(days=1)), ("x", "b", "info", "production", day + timedelta(days=9)), ("x", "b", "ERROR", "production", day + timedelta(days=10))]
    incident = "id string, affected_component_id string, severity string, created_at timestamp"
    hits = [(f"i{i}", "b", "critical" if i == 0 else "LOW", day + timedelta(days=i)) for i in range(6)] + [("k", "a", "Critical", day)]
    found = analysis.evidence_factors(relevant, frame(event, *rows), frame(incident, *hits))
    assert tuples(found) == sorted([("p", "RUNTIME", 70.0, True), ("p", "INCIDENTS", 60.0, True), ("q", "RUNTIME", 40.0, True), ("q", "INCIDENTS", 90.0, True), ("r", "RUNTIME", 0.0, True), ("r", "INCIDENTS", 0.0, False)], key=repr)
    base = frame("pair string, factor string, score double, applies boolean", ("p", "IMPACT_BREADTH", 75.0, True), ("p", "IMPACT_DEPTH", 0.0, False), ("p", "TEST_IMPACT", 45.0, True), ("q", "IMPACT_BREADTH", 20.0, True))
    rails = frame("snapshot_id string, guardrail string, status string, severity string", ("p", "LAYERS", "VIOLATION", "HIGH"), ("q", "LAYERS", "VIOLATION", "CRITICAL"), ("s", "COUPLING", "WARN", None))
    assert tuples(analysis.architecture_factors(rails)) == [("p", 80.0), ("q", 100.0), ("s", 40.0)]
    none = frame("pair string, factor double")
    every = analysis.all_factors(base, rails, none, none, none, found)
    assert {f for _, f in tuples(every, "pair", "factor")} == set(analysis.WEIGHTS) and every.where("pair = 'r'").count() == 0
    weights = analysis.WEIGHTS
    scores = {f: s for f, s in tuples(every.where("pair = 'p' and applies"), "factor", "score")}
    mean = sum(s * weights[f] for f, s in scores.items()) / sum(weights[f] for f in scores)
    risk = {p: (s, c) for p, s, c in tuples(analysis.combined_risk(every))}
    assert abs(risk["p"][0] - mean) < 1e-6 and risk["p"][1] == "CRITICAL"  # broad, live and against a guardrail
    assert risk["q"][1] == "CRITICAL"
    with pytest.raises(Exception, match="no weight for factor"):
        analysis.combined_risk(frame("pair string, factor string, score double, applies boolean", ("p", "SURPRISE", 1.0, True))).collect()
