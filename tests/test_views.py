from graphloom.operators import evaluation, lookup, structure, views, whatif
from graphloom.operators.graph import nodes
from tests.conftest import tuples

ART = "id string, snapshot_id string, artifact_type string, language string, name string, qualified_name string, signature string, docstring string, location string, line_start int, line_end int, metadata map<string,string>"
EDGES = "id string, snapshot_id string, source_artifact_id string, target_artifact_id string, relationship_type string, confidence double"
EXT = "id string, artifact_type string, language string, name string, qualified_name string, location string"


def art(i, q, kind="METHOD", loc=None, s="s"):
    return (i, s, kind, "python", q.split(".")[-1] if q else None, q, None, None, loc, 1, 9, None)


def edge(i, a, b, rel="CALLS", s="s"):
    return (i, s, a, b, rel, 1.0)


def test_rollup(frame):
    arts = frame(ART, art("k", "m.K", "CLASS", "m/k.py:1"), art("k1", "m.K.run", loc="m/k.py:5"), art("l", "n.L", "CLASS", "n/l.py:1"), art("l1", "n.L.go", loc="elsewhere.py:3"), art("z", "z.f", loc="z.py:1"), art(None, None) if False else art("q", None))
    edges = frame(EDGES, edge("1", "k1", "l1"), edge("2", "k", "l"), edge("3", "k1", "k"), edge("4", "z", "k"), edge("5", "k1", "l1"))
    visible = views.visible_nodes(arts, edges, 2)
    assert tuples(visible, "id") == [("k",), ("l",)]
    assert tuples(views.rolled_up_edges(arts, edges, visible)) == [("s", "k", "l", "CALLS")]
    assert views.visible_nodes(arts, edges, 4).count() == 6


def test_file_tree(frame):
    rows = tuples(views.file_tree(frame(ART, art("a", "x", loc="p/q.py:1"), art("b", "y", loc="p\\q.py:2"), art("c", "z", loc=None))))
    assert rows == [("s", "p", "", True, 2), ("s", "p/q.py", "p", False, 2)]


def test_whatif_leaves_the_base_alone(frame):
    arts = frame(ART, art("a", "m.a"), art("b", "m.b"), art("c", "m.c"))
    edges = frame(EDGES, edge("1", "a", "b"), edge("2", "b", "c"), edge("3", "a", "b", "IMPORTS"), edge("1", "a", "b"))
    gone = frame("snapshot_id string, id string", ("s", "b"), ("s", "b"), ("t", "a"))
    kept_a, kept_e = whatif.without_components(arts, edges, gone)
    assert tuples(kept_a, "id") == [("a",), ("c",)] and tuples(kept_e) == []
    pair = frame("snapshot_id string, source_artifact_id string, target_artifact_id string, relationship_type string", ("s", "a", "b", "CALLS"))
    assert tuples(whatif.without_dependencies(edges, pair), "id") == [("2",), ("3",)]
    assert tuples(whatif.without_dependencies(edges, pair.drop("relationship_type")), "id") == [("2",)]
    more = whatif.with_dependencies(edges, frame("snapshot_id string, source_artifact_id string, target_artifact_id string, relationship_type string", ("s", "c", "a", None), ("s", "c", "a", None)))
    assert more.count() == 4 and ("c", "a", "DEPENDS_ON") in tuples(more, "source_artifact_id", "target_artifact_id", "relationship_type")
    kinds = whatif.retyped(edges, frame("snapshot_id string, source_artifact_id string, target_artifact_id string, new_type string", ("s", "a", "b", "USES")))
    assert tuples(kinds, "id", "relationship_type") == [("1", "USES"), ("2", "CALLS"), ("3", "IMPORTS")]
    assert tuples(whatif.with_changed_signatures(arts, gone), "id", "signature") == [("a", None), ("b", " #changed"), ("c", None)]
    assert edges.count() == 4 and {s for (s,) in tuples(whatif.virtual(edges), "snapshot_id")} == {"s#virtual"}
    plans = frame("snapshot_id string, mutation_type string, source string, target string", ("s", "ADD_DEPENDENCY", "a", "b"), ("s", "ADD_DEPENDENCY", "a", "a"), ("s", "REMOVE_DEPENDENCY", "c", "a"), ("s", "REMOVE_COMPONENT", None, "zz"), ("s", "MODIFY_SYMBOL", None, "a"), ("s", "ADD_DEPENDENCY", "zz", "a"))
    verdicts = {(m, s, t): (v, r) for m, s, t, v, r in tuples(whatif.validation(plans, arts, edges), "mutation_type", "source", "target", "status", "reason")}
    assert verdicts == {
        ("ADD_DEPENDENCY", "a", "b"): ("WARNING", "DUPLICATE"), ("ADD_DEPENDENCY", "a", "a"): ("WARNING", "SELF_LOOP"), ("REMOVE_DEPENDENCY", "c", "a"): ("ERROR", "NO_SUCH_DEPENDENCY"),
        ("REMOVE_COMPONENT", None, "zz"): ("ERROR", "UNKNOWN_TARGET"), ("MODIFY_SYMBOL", None, "a"): ("OK", None), ("ADD_DEPENDENCY", "zz", "a"): ("ERROR", "UNKNOWN_SOURCE"),
    }


def test_evaluation(frame):
    case = "case_id string, entity string"
    rows = evaluation.confusion(frame(case, ("c", "a"), ("c", "b"), ("c", "b"), ("d", "x")), frame(case, ("c", "b"), ("c", "z"), ("e", "y")))
    assert tuples(rows, "case_id", "tp", "fp", "fn", "precision", "recall", "f1") == [("c", 1, 1, 1, 0.5, 0.5, 0.5), ("d", 0, 1, 0, 0.0, 0.0, 0.0), ("e", 0, 0, 1, 0.0, 0.0, 0.0)]
    assert tuples(evaluation.micro_average(rows), "tp", "fp", "fn") == [(1, 2, 2)]
    labels = frame("case_id string, entity string, source string, is_independent boolean", ("a", "x", "human", True), ("b", "x", "system_output", True), ("c", "x", None, False), ("d", None, "human", True))
    assert tuples(evaluation.independent(labels)) == [("a",)]
    steps = evaluation.path_steps(frame("graph string, root string, node string, path array<string>", ("s", "a", "c", ["a", "b", "c"])), frame(EDGES, edge("1", "b", "a"), edge("2", "b", "z")))
    assert tuples(steps) == [("s", "a", "c", 2, 1)]


def test_lookups(frame):
    arts = frame(ART, art("a", "m.Foo", loc="m/x.py:1"), art("b", "n.Foo", loc="n/x.py:1"), art("c", "m.bar", loc="m/y.py:4"))
    wanted = frame("snapshot_id string, ident string", ("s", "m.Foo"), ("s", "Foo"), ("s", "M.BAR"), ("s", "m/y.py"), ("s", "none"), ("s", None), ("t", "a"), ("s", "a"))
    assert tuples(lookup.resolved_entities(arts, wanted), "ident", "artifact_id", "matched_by", "ambiguous") == [("Foo", "a", "name", True), ("M.BAR", "c", "any_case", False), ("a", "a", "id", False), ("m.Foo", "a", "qualified_name", False), ("m/y.py", "c", "file", False)]
    lines = frame("snapshot_id string, file string, first_line int, last_line int", ("s", "m/y.py", 9, 20), ("s", "m/y.py", 10, 20), ("t", "m/y.py", 1, 9))
    assert tuples(lookup.symbols_at(lines, arts), "artifact_id") == [("c",)]
    edges = frame(EDGES, edge("1", "a", "b"), edge("2", "b", "a"), edge("3", "a", "x"), edge("4", "c", "c"))
    assert tuples(lookup.mutual_edges(edges)) == [("s", "a", "b")]
    assert tuples(lookup.dependencies(edges, nodes(arts, frame(EXT))), "source_name", "target_name") == [("Foo", "Foo"), ("Foo", "Foo"), ("Foo", "unknown"), ("bar", "bar")]
    pats = frame("prefix string, layer string", ("m", "one"), ("m.bar", "two"), ("ba", "no"))
    rows = lookup.longest_prefix(frame("q string", ("m.bar",), ("backend.m.Foo",), ("mm",), (None,)), "q", pats, "layer")
    assert tuples(rows) == sorted([("m.bar", "two"), ("backend.m.Foo", "one"), ("mm", None), (None, None)], key=repr)


def test_empty_aggregates(frame):
    a, e = frame(ART), frame(EDGES)
    for df in (structure.type_counts(a, e), structure.overview(a, e), structure.packages(a), structure.language_share(a), structure.clusters(a), structure.cluster_edges(a, e), structure.file_health(a, e), structure.top_records(a, e), structure.hubs(a, e), views.entry_points(a), views.file_tree(a)):
        assert tuples(df) == []
