from graphloom.operators import review
from tests.conftest import tuples

ART = "id string, snapshot_id string, artifact_type string, name string, qualified_name string, location string, line_start int, line_end int, signature string"


def test_live_changes(frame):
    arts = frame(ART, ("a", "s", "METHOD", "a", "m.a", "m.py:1", 1, 5, None), ("b", "s", "METHOD", "b", "m.b", "m.py:7", 7, None, None), ("c", "s", "METHOD", "c", "o.c", "old.py:1", 1, 5, None), ("d", "s", "METHOD", "d", "g.d", "gone.py:1", 1, 2, None))
    files = frame("change_type string, path string, old_path string", ("MODIFIED", "m.py", None), ("RENAMED", "new.py", "old.py"), ("REMOVED", "gone.py", None), ("ADDED", "fresh.py", None), ("MODIFIED", "doc.md", None))
    lines = frame("path string, first_line int, last_line int", ("m.py", 7, 7), ("m.py", 7, 9))
    rows = tuples(review.live_changes(files, lines, arts), "path", "artifact_id", "confidence")
    assert [r for r in rows if not r[1].startswith("file_")] == [("gone.py", "d", 0.95), ("m.py", "b", 0.95), ("new.py", "c", 0.85)]
    assert sorted(r[0] for r in rows if r[1].startswith("file_")) == ["doc.md", "fresh.py"]


def test_graph_changes(frame):
    arts = frame(ART, ("a1", "s1", "M", "a", "m.a", "x", 1, 2, None), ("b1", "s1", "M", "b", "m.b", "x", 1, 2, None), ("a2", "s2", "M", "a", "m.a", "x", 1, 3, ""), ("c2", "s2", "M", "c", "m.c", "x", 1, 2, None))
    pairs = frame("snapshot_id string, previous_id string", ("s2", "s1"))
    assert tuples(review.graph_changes(pairs, arts)) == [("s2", "a2", "modified"), ("s2", "c2", "added"), ("s2", "removed_b1", "removed")]
    assert tuples(review.graph_changes(pairs.limit(0), arts)) == []


def test_contradictions(frame):
    arts = frame(ART, ("t", "s", "TEST_CASE", "t", "m.t", "x", 1, 2, None), ("f", "s", "METHOD", "f", "m.f", "x", 1, 2, None))
    changes = frame("pair string, artifact_id string, change_type string", ("s", "t", "MODIFIED"))
    rest = frame("pair string, test_id string", ("s", "t"), ("s", "f"), ("s", "t"))
    assert tuples(review.contradictions(changes, rest, arts)) == [("f", "NOT_A_TEST"), ("t", "CHANGED_BUT_UNAFFECTED"), ("t", "CHANGED_BUT_UNAFFECTED")]


def test_intents_of_long_questions(frame):
    long = "Did the incident " + "of that service and its many parts " * 10 + "Really end?"
    assert tuples(review.question_intents(frame("doc_id bigint, text string", (1, long)))) == [(1, "incident", 1)]


def test_intents(frame):
    rows = review.question_intents(frame("doc_id bigint, text string", (1, "Which tests must run? Well. What does it affect downstream?"), (2, None), (3, "no question")))
    assert tuples(rows) == [(1, "impact", 1), (1, "test", 1)]
