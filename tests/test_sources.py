import textwrap

from graphloom.operators import conformance, discovery, extraction
from graphloom.sources.baseline import Baseline, load_baseline
from graphloom.sources import files as source_files
from graphloom.sources.files import scan_report, scan_tree
from graphloom.sources.logs import ancestors, commits, hunks, labels, name_status
from tests.conftest import tuples

PYTHON = textwrap.dedent(
    '''
    import os.path
    from shop.models import Order
    class Cart(Base):
        def add(self, x):
            print(x)
            return check(x)
    @app.get("/orders")
    async def orders():
        return Order.all()
    def test_add():
        Cart().add(1)
    '''
)


def test_python_records():
    rows = extraction.python_records("src/shop/cart.py", PYTHON)
    arts = {(r[1], r[4]) for r in rows if r[0] == "A"}
    assert arts == {("MODULE", "src.shop.cart"), ("CLASS", "src.shop.cart.Cart"), ("METHOD", "src.shop.cart.Cart.add"), ("FUNCTION", "src.shop.cart.orders"), ("API_ENDPOINT", "src.shop.cart::GET /orders"), ("TEST_CASE", "src.shop.cart.test_add")}
    links = {(r[1], r[4], r[5]) for r in rows if r[0] == "E"}
    assert {("EXTENDS", "src.shop.cart.Cart", "Base"), ("CALLS", "src.shop.cart.Cart.add", "check"), ("EXPOSES", "src.shop.cart.orders", "src.shop.cart::GET /orders"), ("TESTS", "src.shop.cart.test_add", "add"), ("IMPORTS", "src.shop.cart", "shop.models"), ("IMPORTS", "src.shop.cart", "os.path")} <= links
    assert not any(r[5] == "print" for r in rows)
    assert [r[1] for r in extraction.python_records("a.py", "def (:")] == ["MODULE"]


def test_lines_of_languages(frame):
    java = "package shop.cart;\npublic class Basket {\n    private int n = 1;\n    public int add(int x) {\n        return check(x);\n    }\n    @PostMapping(\"/add\")\n    protected static List<String> names() throws IOException {\n}\n"
    test = "class BasketTest {\n    @Test\n    public void adds() {\n    }\n}\n"
    compose = "version: '3'\nservices:\n  web:\n    image: x\n    environment:\n      A: b\n  # note\n  db:\n    image: y\nvolumes:\n  data:\n"
    docker = "FROM python:3\nFROM node:20 AS ui\nEXPOSE 8080\n"
    script = "export const load = async (x) => 1\nconst n = 3\n"
    rows = [("src/Basket.java", "java", java), ("test/BasketTest.java", "java", test), ("docker-compose.yml", "yaml", compose), ("other.yml", "yaml", compose), ("Dockerfile", "dockerfile", docker), ("a.ts", "typescript", script)]
    found = extraction.line_languages(frame("path string, language string, text string", *rows))
    arts = {(k, n) for k, n in tuples(found.where("record = 'A'"), "kind", "name")}
    assert {("PACKAGE", "cart"), ("METHOD", "add"), ("METHOD", "names"), ("TEST_CASE", "adds"), ("SERVICE", "web"), ("SERVICE", "db"), ("DOCKER_STAGE", "python:3"), ("DOCKER_STAGE", "ui"), ("FUNCTION", "load")} <= arts
    assert not {("SERVICE", "data"), ("SERVICE", "image"), ("METHOD", "check"), ("FUNCTION", "n"), ("DOCKER_STAGE", "node:20")} & arts
    links = {(k, q, t) for k, q, t in tuples(found.where("record = 'E'"), "kind", "qualified_name", "target")}
    assert {("CONTAINS", "src/Basket.java::Basket", "src/Basket.java::Basket.add"), ("TESTS", "test/BasketTest.java::BasketTest.adds", "Basket"), ("EXPOSES", "src/Basket.java::Basket", "src/Basket.java::/add"), ("DEPENDS_ON", "Dockerfile", "node:20"), ("EXPOSES", "Dockerfile", "8080")} <= links


def test_limits_are_reported(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(source_files, "MAX_FILE_BYTES", 10)
    monkeypatch.setattr(source_files, "MAX_DEPTH", 3)
    for name, text in {"a.py": "x = 1\n", "big.py": "x" * 11, "p/q/r/s.py": "x\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    tree = scan_tree(spark, str(tmp_path))
    assert tuples(tree, "path", "skipped", "text") == [("a.py", None, "x = 1\n"), ("big.py", "file_size", None), ("p/q/r/s.py", "depth", None)]
    assert tuples(scan_report(tree, max_files=2)) == [(3, 19, 1, 0, 1, True)]
    assert tuples(scan_report(tree, None, None), "over_limit") == [(False,)]


def test_tree_to_graph(spark, tmp_path):
    files = {
        "src/shop/cart.py": PYTHON, "web/app.ts": "import { x } from './x'\nexport class Page {}\nexport function go() {}\ntest('opens', () => {})\n", "A.java": "import a.b.C;\npublic class A extends B {}\ninterface I {}\n@GetMapping(\"/a\")\n",
        "m.cbl": "       IDENTIFICATION DIVISION.\n       COPY BOOK-1.\n", "n.cpp": "#include <vector>\nstruct P {};\n", "t.sql": "create table if not exists orders (id int);\n", "Dockerfile": "FROM python:3 AS base\n", "requirements.txt": "fastapi==0.110.0\npytest\n", "node_modules/x.js": "class Z {}", ".git/config": "x",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "b.bin").write_bytes(b"a\x00b")
    (tmp_path / "c.bin").write_bytes(bytes(range(1, 9)) * 20 + b"abc")
    (tmp_path / "u.py").write_text("# größe ✓\n", encoding="utf-8")
    tree = scan_tree(spark, str(tmp_path))
    rows = {r.path: r for r in tree.collect()}
    assert set(rows) == {n for n in files if not n.startswith(("node_modules", ".git"))} | {"b.bin", "c.bin", "u.py"}
    assert rows["b.bin"].is_binary and rows["c.bin"].is_binary and not rows["u.py"].is_binary
    assert rows["src/shop/cart.py"].line_count == PYTHON.count("\n") and rows["Dockerfile"].language == "dockerfile" and rows["m.cbl"].language == "cobol"
    records = extraction.extracted(tree)
    kinds = {(k, q) for k, q in tuples(records.where("record = 'A'"), "kind", "qualified_name")}
    assert {("CLASS", "web/app.ts::Page"), ("TEST_CASE", "web/app.ts::opens"), ("INTERFACE", "A.java::I"), ("API_ENDPOINT", "A.java::/a"), ("COBOL_DIVISION", "m.cbl::IDENTIFICATION"), ("CPP_STRUCT", "n.cpp::P"), ("SQL_TABLE", "db::table::orders"), ("DOCKER_STAGE", "Dockerfile::base")} <= kinds
    links = {(k, t) for k, t in tuples(records.where("record = 'E'"), "kind", "target")}
    assert {("IMPORTS", "./x"), ("EXTENDS", "B"), ("COPY_DEPENDS_ON", "BOOK-1"), ("INCLUDES", "vector"), ("EXPORTS", "web/app.ts::go")} <= links
    arts, edges = extraction.linked(records, "snap")
    ids = {r.id for r in arts.collect()}
    assert len(ids) == arts.count() and all(r.source_artifact_id in ids and r.target_artifact_id in ids for r in edges.collect())
    assert ("EXTERNAL_DEPENDENCY", "vector") in tuples(arts, "artifact_type", "name")
    out = str(tmp_path / "out")
    for _ in range(2):
        extraction.write_snapshot(edges, out)
    assert spark.read.parquet(out).count() == edges.count()
    assert ("package", "pip") in tuples(discovery.manifests(tree), "kind", "tool")
    assert ("framework", "fastapi", "0.110.0") in tuples(discovery.technologies(tree), "kind", "technology", "version")


def test_security_findings(frame):
    text = "api_key = 'abcdefgh12345678ijkl'\n# eval(x)\nx = eval(user)\napi_key = 'example-abcdefgh12345678'\n-----BEGIN RSA PRIVATE KEY-----"
    rows = tuples(discovery.security_findings(frame("path string, text string", ("a", text), ("b", None))), "line_no", "finding", "evidence")
    assert rows == [(1, "CREDENTIAL", "api_key = 'abcd****ijkl'"), (3, "UNSAFE_EVAL", "x = eval(user)"), (5, "PRIVATE_KEY", "-----BEGIN RSA PRIVATE KEY-----")]


def test_git_texts(frame, spark, tmp_path):
    log = frame("value string", ("c2\x1fc1 c0\x1fann\x1f2026-01-02\x1fmerge it\n3\t1\ta.py\n-\t-\tb.bin\n",), ("c1\x1f\x1fbob\x1f2026-01-01\x1ffirst",), ("junk",))
    rows = commits(log)
    assert tuples(rows, "commit_sha", "is_merge", "files_changed", "additions", "deletions") == [("c1", False, 0, 0, 0), ("c2", True, 2, 3, 1)]
    assert tuples(ancestors(rows), "commit_sha", "ancestor") == [("c2", "c0"), ("c2", "c1")]
    assert tuples(name_status(frame("value string", ("A\tx.py",), ("R090\told.py\tnew.py",), ("?",)))) == [("ADDED", "x.py", None), ("RENAMED", "new.py", "old.py")]
    assert tuples(hunks(frame("path string, text string", ("a", "@@ -1,2 +3,4 @@ f\n+x\n@@ -9 +12 @@\n@@ -20,3 +19,0 @@")))) == [("a", 12, 12), ("a", 19, 19), ("a", 3, 6)]
    (tmp_path / "l.json").write_text('{"case_id": "c", "is_independent": true, "items": [{"entity": "a", "source": "human"}]}')
    assert tuples(labels(spark, str(tmp_path / "l.json")), "case_id", "is_independent", "entity") == [("c", True, "a")]


def test_ancestors_of_many_generations(frame):
    rows = frame("commit_sha string, parent_hashes array<string>", ("c0", ["c1"]), *((f"c{i}", [f"c{i + 1}"]) for i in range(1, 67)))
    last = ancestors(rows).where("commit_sha = 'c0'")
    assert last.count() == 67


NODE = "id string, artifact_type string, language string, name string, qualified_name string, location string, snapshot_id string"
EDGES = "id string, snapshot_id string, source_artifact_id string, target_artifact_id string, relationship_type string"


def test_conformance(frame, spark, tmp_path):
    (tmp_path / "b.yaml").write_text("layers:\n  ui: {modules: [web], allowed: [core], forbidden: []}\n  core: {modules: [core, core/plain], allowed: [], forbidden: [ui]}\n  db: {modules: [store]}\nforbidden_imports:\n  core: [requests]\n")
    base = load_baseline(spark, str(tmp_path / "b.yaml"))
    nodes = frame(NODE, *((i, "MODULE", "py", q, q, f"{q}.py:1", "s") for i, q in (("w", "backend.web.page"), ("c", "core.logic"), ("d", "store.main"), ("r", "requests.get"), ("x", "webby"), ("n", None))))
    edges = frame(EDGES, ("1", "s", "c", "w", "IMPORTS"), ("2", "s", "w", "d", "CALLS"), ("3", "s", "w", "c", "CALLS"), ("4", "s", "c", "r", "IMPORTS"), ("5", "s", "c", "x", "IMPORTS"), ("6", "s", "c", "w", "CALLS"), ("7", "s", "c", "w", "CONTAINS"), ("8", "s", "n", "w", "CALLS"))
    found = conformance.drift(edges, nodes, base)
    assert tuples(found.drop("snapshot_id")) == [("FORBIDDEN_IMPORT", "HIGH", "core.logic", "requests.get"), ("LAYER_BOUNDARY", "HIGH", "core.logic", "backend.web.page"), ("LAYER_BOUNDARY", "MEDIUM", "backend.web.page", "store.main")]
    assert tuples(conformance.conformance(edges, nodes, found, base)) == [("s", 7, 3, 70.0)]
    moved = conformance.drift_changes(found.unionByName(found.limit(0)), frame("snapshot_id string, previous_id string", ("s", "r"), ("t", "s")))
    assert {(p, s) for p, s in tuples(moved, "pair", "state")} == {("s", "new"), ("t", "resolved")}
    assert tuples(conformance.drift(edges, nodes, Baseline(spark, {}))) == []


def test_full_drift(frame, spark):
    base = Baseline(spark, {"rules": [{"source": "a", "target": "lib.x", "category": "BYPASS", "severity": "LOW"}, {"source": "b", "target": "c", "forbidden": False}]})
    names = {"a": "a.one", "b": "b", "c": "c", "d": "d", "e": "e", "f": "f", "x": "lib.x.y", "z": "lib.xx", "g": "ab"}
    nodes = frame(NODE, *((i, "MODULE", "py", q, q, f"{q}.py:1", "s") for i, q in names.items()))
    links = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "a"), ("c", "a"), ("a", "x"), ("a", "x"), ("a", "z"), ("g", "x")]
    edges = frame(EDGES, *((str(i), "s", a, b, "REFERENCES") for i, (a, b) in enumerate(links)))
    found = conformance.full_drift(edges, nodes, base)
    assert tuples(found.drop("snapshot_id")) == [("BYPASS", "LOW", "a.one", "lib.x.y")] + [("CIRCULAR_DEPENDENCY", "CRITICAL", "a.one", "b")] * 2
    assert base.rule_count == 2


def test_import_lines(frame):
    rows = conformance.import_lines(frame("path string, text string", ("a.py", "import os\r\n  from x.y import z\nimportant = 1"), ("b", "")))
    assert tuples(rows) == [("a.py", 1, "os"), ("a.py", 2, "x.y")]
