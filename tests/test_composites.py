from pyspark.sql import functions as F

from graphloom.operators import composites
from graphloom.sources.baseline import Baseline
from graphloom.sources.tables_out import dimension, load_result, save_result, upserted, without_partition
from tests.conftest import tuples

NODE = "id string, artifact_type string, language string, name string, qualified_name string, location string, snapshot_id string"
EDGES = "id string, snapshot_id string, source_artifact_id string, target_artifact_id string, relationship_type string"


def test_simulated_outage_uses_the_base(frame):
    arts = frame(NODE, *((i, "METHOD", "py", i, i, f"{i}.py:1", "s") for i in "abc"))
    edges = frame(EDGES, ("1", "s", "a", "b", "CALLS"), ("2", "s", "c", "a", "USES"))
    rows = composites.simulated_outage(arts, edges, arts, frame("snapshot_id string, id string", ("s", "b"), ("s", "b")))
    assert tuples(rows) == [("s", "b", 2, 0, 0, 16, "LOW", 2, 1)]
    nodes = composites.blast_nodes(frame("graph string, root string", ("s", "b")), edges, 1)
    assert tuples(nodes, "node", "depth", "confidence") == [("a", 1, 1.0)]


def test_processes(frame):
    steps = frame("graph string, root string, node string, step int", ("s", "r", "x", 1), ("s", "r", "r", 0), ("s", "q", "q", 0))
    assert tuples(composites.processes_through(steps, frame("graph string, node string", ("s", "x"), ("s", "x"), ("t", "q")))) == [("s", "r", "x", 1)]
    assert tuples(composites.process_lists(steps)) == [("s", "q", 1, "q"), ("s", "r", 2, "r>x")]


def test_file_drift(frame, spark):
    base = Baseline(spark, {"layers": {"ui": {"modules": ["web"], "allowed": ["core"]}, "core": {"modules": ["core"], "forbidden": ["ui"]}, "db": {"modules": ["store"]}}, "forbidden_imports": {"core": ["requests"]}})
    files = frame("path string, text string", ("core/a.py", "import web.page\nimport requests.api\nimport os\nimport web.page"), ("web/b.py", "from store import x\nfrom core.a import y"))
    assert tuples(composites.file_drift(files, base), "path", "line_no", "severity", "module") == [("core/a.py", 1, "HIGH", "web.page"), ("core/a.py", 2, "HIGH", "requests.api"), ("core/a.py", 4, "HIGH", "web.page"), ("web/b.py", 1, "MEDIUM", "store")]


def test_symbols_and_confidence(frame):
    arts = frame(NODE, ("1", "M", "py", "a", "m.a", "a.py:1", "s1"), ("2", "M", "", "b", "m.b", "a.py:2", "s1"), ("3", "M", None, "a", " m.a", "b.cbl:1", "s2"), ("4", "M", "py", "c", "m.c", "c.py:1", "s2"), ("5", "M", "py", "n", None, None, "s2"))
    pairs = frame("snapshot_id string, previous_id string", ("s2", "s1"))
    assert tuples(composites.common_symbols(pairs, arts)) == [("s2", 1, 1, 1)]
    assert tuples(composites.completeness(arts), "snapshot_id", "files", "analysed", "status") == [("s1", 1, 1, "COMPLETE"), ("s2", 3, 2, "PARTIAL")]
    chosen = frame("pair string, to_run bigint, to_skip bigint", ("s2", 0, 0))
    assert tuples(composites.confidence(pairs, chosen, frame("snapshot_id string", ("s2",)))) == [("s2", 0.65, "MEDIUM")]


def test_upsert_and_dimension(frame):
    base = frame("id string, a int, b string", ("x", 1, "p"), ("y", 2, None))
    updates = frame("id string, a int, b string, t int", ("x", 9, None, 1), ("x", 8, "q", 2), ("z", 5, "n", 1), ("y", None, "s", 1))
    assert tuples(upserted(base, updates, ["id"], F.col("t"))) == [("x", 8, "q"), ("y", 2, "s"), ("z", 5, "n")]
    assert tuples(upserted(base, updates.limit(0), ["id"])) == tuples(base)
    names = dimension(frame("id string, name string", ("1", "go")), frame("language string", ("go",), ("py",), ("py",), (None,)), "language")
    assert tuples(names, "name") == [("go",), ("py",)]
    assert tuples(without_partition(base, "id", "x"), "id") == [("y",)]


def test_results(frame, spark, tmp_path):
    path = str(tmp_path / "results")
    save_result(frame("v int", (1,), (2,)), path, "one")
    save_result(frame("v int", (3,)), path, "two")
    save_result(frame("v int", (4,)), path, "one")
    assert tuples(load_result(spark, path, "one")) == [(4,)] and tuples(load_result(spark, path, "two")) == [(3,)]
    assert tuples(load_result(spark, path, "none")) == []
