import json

import numpy as np

from graphloom.functions.names import similarity
from graphloom.functions.trees import assignment, mapping, tree
from graphloom.operators.schema_drift import as_kind, common_kind, consistent_table, dotted, drift, leaves, parse_line, projections, schema_changes
from tests.conftest import tuples

LINES = "feed_id string, file_no int, line_no int, line string, kind string, path string"


def lines(frame, files, feed="f"):
    rows = []
    for number, events in files.items():
        for i, e in enumerate(events):
            rows.append((feed, number, i + 1, e if isinstance(e, str) or e is None else json.dumps({"event_type": "LOG", "attributes": e}), "x", "y"))
    return frame(LINES, *rows)


def changes(df):
    return tuples(schema_changes(drift(df)[1]), "feed_id", "file_no", "field_name", "change")


def test_kinds_of_change(frame):
    df = lines(frame, {
        1: [{"http_method": "GET", "version": "v2.1.3", "secret_key": "fake-1a2b", "queue_depth": 3}, {"http_method": "PUT"}],
        2: [{"req": {"verb": "GET"}, "version": 20103, "secret_key": "fake-1a2c", "queue_depth": 4}, {"req": {"verb": "PUT"}}],
        3: [{"req": {"verb": 2}, "build": {"version": [2, 1, 3]}, "queue_depth": 4}],
        4: [{"req": {"verb": 2}, "build": {"version": [2, 1, 3]}, "queue_depth": None, "sk": "fake-9"}],
    })
    assert changes(df) == sorted([
        ("f", 2, "req.verb", "renamed"), ("f", 2, "version", "retyped"),
        ("f", 3, "req.verb", "retyped"), ("f", 3, "build.version", "renamed"), ("f", 3, "build.version", "retyped"), ("f", 3, "secret_key", "removed"),
        ("f", 4, "sk", "added"), ("f", 4, "queue_depth", "removed"),
    ], key=repr)


def test_unrelated_fields_are_not_a_rename(frame):
    df = lines(frame, {1: [{"version": "v1.2.3", "a": 1}], 2: [{"retry_count": 3, "a": 1}]})
    assert changes(df) == [("f", 2, "retry_count", "added"), ("f", 2, "version", "removed")]


def test_unknown_names_by_values(frame):
    df = lines(frame, {1: [{"flavour": x} for x in ("sour", "sweet", "salty")], 2: [{"taste": x} for x in ("sweet", "salty", "sour")]})
    assert changes(df) == [("f", 2, "taste", "renamed")]


def test_unreadable_lines_and_gaps(frame):
    df = lines(frame, {1: [{"a": 1}, "", None, "#{", '{"x": ', "[1]", "3", '{"attributes": 7}'], 2: [{"a": 1}, {"a": 1}], 4: [{"b": 1}], 5: ['{"attributes": null}']})
    assert changes(df) == [("f", 5, "b", "removed")]
    assert tuples(drift(lines(frame, {}))[0]) == [] == tuples(drift(lines(frame, {}))[1])
    assert changes(frame(LINES, (None, 1, 1, "{}", "", ""), ("f", None, 1, "{}", "", ""))) == []


def test_counter_examples_of_names(frame):
    """Names alike in meaning to a reader but with other values are no rename; the very same values under other names are one."""
    pairs = [
        ({"auth": {"token": ["u7-%d" % i]}}, {"user_password": "zz top %d" % (i * 7)}, False),
        ({"status_code": 200 + i}, {"outcome": "went fine"}, False),
        ({"primary_key": 900_000 + i}, {"secret": "hush hush"}, False),
        ({"node": f"rack {i % 5} unit"}, {"user": f"rack {i % 5} unit"}, True),
    ] if (i := 0) == 0 else []
    for k, (old, new, renamed) in enumerate(pairs):
        found = {c for *_, c in changes(lines(frame, {1: [old, old], 2: [new, new]}, feed=f"f{k}"))}
        assert found == ({"renamed"} if renamed else {"added", "removed"}), (old, new)


def test_learned_values_tell_a_rename_with_a_new_type(frame):
    """No list knows these names; other feeds show that ``flavour`` and ``taste`` hold the same values."""
    made = []
    for f in range(12):
        name = "taste" if f % 2 else "flavour"
        files = {1: [{name: x, "grams": 40 + f} for x in ("sour", "sweet", "salty")], 2: [{name: x, "grams": 40 + f} for x in (1, 2, 3)]}
        made.append(lines(frame, files, feed=f"g{f:02d}"))
    made.append(lines(frame, {1: [{"flavour": x, "grams": 7} for x in ("sour", "sweet")], 2: [{"taste": x, "grams": 8} for x in (1, 2, 3)]}, feed="h"))
    df = made[0]
    for m in made[1:]:
        df = df.union(m)
    assert [r for r in changes(df) if r[0] == "h"] == [("h", 2, "taste", "renamed"), ("h", 2, "taste", "retyped")]


def test_objects_renamed_and_moved(frame):
    old = {"http": {"a": "x1", "b": 7, "c": True}, "keep": {"z": 1, "mark": "left right"}, "place": {"y": 2}}
    new = {"request": {"a": "x1", "b": 7, "c": True}, "keep": {"z": 1}, "place": {"y": 2, "mark": "left right"}}
    scripts = drift(lines(frame, {1: [old], 2: [new]}))[1]
    got = [(o, n, a and dotted(a), b and dotted(b)) for o, n, a, b in tuples(scripts, "operation", "node", "path_before", "path_after")]
    assert got == sorted([("rename", "object", "http", "request"), ("move", "field", "keep.mark", "place.mark"), *(("carry", "field", f"http.{c}", f"request.{c}") for c in "abc")], key=repr)
    assert tuples(schema_changes(scripts), "field_name", "change") == [("place.mark", "renamed"), *((f"request.{c}", "renamed") for c in "abc")]


def test_dots_inside_names(frame):
    scripts = drift(lines(frame, {1: [{"a.b": 1, "c": 2}], 2: [{"a": {"b": 1}, "c": 2}]}))[1]
    assert ("field", "a.b") in tuples(scripts, "node", "path_before") and tuples(schema_changes(scripts)) == []


def test_consistent_table(frame):
    df = lines(frame, {1: [{"flavour": "sour", "http_method": "GET", "n": 1}, {"flavour": "sweet"}], 2: [{"taste": "sour", "req": {"http_method": ["GET"]}, "n": True}, {"taste": "sweet"}, "#x"]})
    df = df.union(df)
    schemas, scripts = drift(df)
    table = consistent_table(df, projections(schemas, scripts))
    maps = [(f, n, *(sorted(m.items()) for m in rest)) for f, n, *rest in tuples(table, "file_no", "line_no", "texts", "numbers", "flags", "lists")]
    field, method = maps[0][2][0][0], maps[0][5][0][0]
    assert field in ("flavour", "taste") and method in ("http_method", "req_http_method")
    assert maps == [
        (1, 1, [(field, "sour")], [("n", 1.0)], [], [(method, ["GET"])]), (1, 2, [(field, "sweet")], [], [], []),
        (2, 1, [(field, "sour")], [("n", 1.0)], [], [(method, ["GET"])]), (2, 2, [(field, "sweet")], [], [], []),
    ]


def test_parts():
    assert {dotted(p): v for p, v in leaves({"a": {"b": 1, "c": None}, "d": [], "e": {}})} == {"a.b": 1, "d": []}
    assert parse_line("{" * 100_000) is None and parse_line('"x"') is None
    assert similarity("sk", "secretKey") == 0.9 and similarity("http_method", "httpMethod") == 1 and similarity("ver", "version") == 0.8
    assert similarity("http_method", "retry_count") == 0
    assert common_kind({"number", "boolean"}) == "number" and common_kind({"list", "string"}) == "list" and common_kind({"boolean"}) == "boolean"
    assert as_kind({"a": 1}, "list") == ['{"a": 1}'] and as_kind(True, "number") == 1.0 and as_kind([1], "string") == "[1]"


def test_assignment_against_brute_force():
    from itertools import permutations

    cost = np.array([[1.0, 0.2, 2.0], [0.1, 0.3, 2.0]])
    assert sorted(assignment(cost)) == [(0, 1), (1, 0)] and sorted(assignment(cost.T)) == [(0, 1), (1, 0)]
    draw = np.random.default_rng(1)
    for _ in range(40):
        n, m = int(draw.integers(1, 5)), int(draw.integers(5, 7))
        c = draw.integers(-9, 9, (n, m)).astype(float)
        assert sum(c[i, j] for i, j in assignment(c)) == min(sum(c[i, p[i]] for i in range(n)) for p in permutations(range(m), n))


def test_tree_distance():
    path = lambda p: p.replace(".", "\x1f")
    made = lambda *p: tree(map(path, p))
    alike = lambda a, b: 0.0 if a[-1] == b[-1] else 2.0
    assert mapping(made("a", "b"), made("a", "b"), alike)[0] == 0
    assert mapping(made("a", "b"), made("a"), alike)[0] == 1
    assert round(mapping(made("k"), made("o.k"), alike)[0], 6) == 0.1  # an object is put in between
    assert round(mapping(made("o.k", "o.l"), made("p.k", "p.l"), alike)[0], 6) == 0.1  # an object has a new name
    assert round(mapping(made("k", "l"), made("o.k", "o.l"), alike)[0], 6) == 0.1
    assert round(mapping(made("o.q.k", "b"), made("k", "b"), alike)[0], 6) == 0.2
    assert mapping(made("a"), made("b"), alike)[0] == 2
    assert mapping(made(), made("x.b"), alike)[0] == 1.1


def test_hot_feed(frame):
    df = lines(frame, {1: [{"a": i, "b": "x"} for i in range(2000)], 2: [{"a": str(i), "b": "x"} for i in range(2000)]})
    assert changes(df.repartition(8)) == [("f", 2, "a", "retyped")]
