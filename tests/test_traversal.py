import random
from collections import deque

from pyspark.sql import functions as F

from graphloom.operators.graph import adjacency, degrees, placeholder_map
from graphloom.operators.traversal import all_forward, causal_paths, components, cycles, forward_of, reach, undirected
from tests.conftest import tuples

EDGES = "id string, snapshot_id string, source_artifact_id string, target_artifact_id string, relationship_type string, confidence double"


def edges(frame, *rows):
    return frame(EDGES, *((f"e{i}", "s", a, b, rel, 1.0) for i, (a, b, rel) in enumerate(rows)))


def reached(frame, links, roots, depth=5, rules=None):
    adj = adjacency(edges(frame, *links), rules) if rules else adjacency(edges(frame, *links))
    found = reach(frame("graph string, root string", *(("s", r) for r in roots)), adj, depth)
    return {(r, n): (d, p) for r, n, d, p in tuples(found.select("root", "node", "depth", F.array_join("path", "")))}


def test_reverse_forward_and_disabled(frame):
    out = reached(frame, [("A", "B", "CALLS"), ("H", "P", "EXPOSES"), ("M", "B", "CONTAINS"), ("T", "B", "TESTS"), ("X", "Y", "NOVEL")], ["B", "H"])
    assert out == {("B", "B"): (0, "B"), ("B", "A"): (1, "BA"), ("B", "T"): (1, "BT"), ("H", "H"): (0, "H"), ("H", "P"): (1, "HP")}


def test_chain_cycle_diamond(frame):
    chain = [(a, b, "CALLS") for a, b in zip("ABCDE", "BCDEF", strict=True)]
    assert max(d for d, _ in reached(frame, chain, ["F"], 2).values()) == 2
    assert len(reached(frame, chain, ["F"], 5)) == 6
    ring = reached(frame, [("A", "B", "CALLS"), ("B", "C", "CALLS"), ("C", "A", "CALLS")], ["A"])
    assert {k: d for k, (d, _) in ring.items()} == {("A", "A"): 0, ("A", "C"): 1, ("A", "B"): 2}
    diamond = reached(frame, [("A", "X", "CALLS"), ("B", "X", "CALLS"), ("T", "B", "CALLS"), ("T", "A", "CALLS")], ["X"])
    assert diamond[("X", "T")] == (2, "XAT")


def test_edge_cases(frame):
    assert reached(frame, [], ["A"]) == {("A", "A"): (0, "A")}
    assert reached(frame, [("A", "A", "CALLS")], ["A"]) == {("A", "A"): (0, "A")}
    assert reached(frame, [("A", "B", "CALLS")] * 3, ["B", "B", None]) == {("B", "B"): (0, "B"), ("B", "A"): (1, "BA")}
    assert reached(frame, [("A", "B", "CALLS"), (None, "B", "CALLS"), ("C", None, "CALLS"), ("D", "B", None)], ["B"]) == {("B", "B"): (0, "B"), ("B", "A"): (1, "BA")}
    assert reached(frame, [("A", "B", "CALLS")], []) == {}


def test_strongest_parallel_edge(frame):
    rows = frame(EDGES, ("1", "s", "A", "B", "CALLS", 0.5), ("2", "s", "A", "B", "CALLS", 0.9), ("3", "s", "A", "B", "IMPORTS", None), ("1", "s", "A", "B", "CALLS", 0.5))
    assert tuples(adjacency(rows)) == [("s", "B", "A", "CALLS", 0.9), ("s", "B", "A", "IMPORTS", 0.95)]


def test_random_graphs_equal_queue_search(frame):
    draw = random.Random(8)
    for _ in range(3):
        links = {(f"{draw.randrange(14):02d}", f"{draw.randrange(14):02d}") for _ in range(30)}
        links = {(a, b) for a, b in links if a != b}
        expected = {}
        for root in sorted({x for p in links for x in p}):
            best, queue = {root: [root]}, deque([root])
            while queue:  # shortest first, then the smallest sequence of ids
                node = queue.popleft()
                for b in sorted(a for a, t in links if t == node):
                    if b not in best and len(best[node]) <= 3:
                        best[b] = [*best[node], b]
                        queue.append(b)
            expected |= {(root, n): (len(p) - 1, "".join(p)) for n, p in best.items()}
        assert reached(frame, [(a, b, "CALLS") for a, b in links], sorted({x for p in links for x in p}), 3) == expected


def test_snapshots_do_not_mix(frame):
    rows = frame(EDGES, ("1", "s", "A", "B", "CALLS", 1.0), ("2", "t", "C", "B", "CALLS", 1.0))
    found = reach(frame("graph string, root string", ("s", "B"), ("t", "B")), adjacency(rows), 3).where("depth > 0")
    assert tuples(found, "graph", "node") == [("s", "A"), ("t", "C")]


def test_cycles(frame):
    links = [("A", "B"), ("B", "A"), ("B", "C"), ("C", "A"), ("C", "D"), ("D", "A"), ("E", "E"), ("A", "B")]
    found = cycles(forward_of(edges(frame, *((a, b, "CALLS") for a, b in links)), ["CALLS"]), 4)
    assert tuples(found.select(F.array_join("path", ""))) == [("AB",), ("ABC",), ("ABCD",)]
    assert tuples(cycles(forward_of(edges(frame), ["CALLS"]), 3)) == []


def test_components_equal_mutual_reach(frame):
    draw = random.Random(5)
    ring = [("s", f"r{i}", f"r{(i + 1) % 11:d}") for i in range(11)] + [("s", "r3", "z0"), ("s", "a0", "r0"), ("s", "z0", "z1"), ("s", "z1", "z0"), ("s", "a0", "a0")]
    links = ring + [(g, f"{draw.randrange(16):02d}", f"{draw.randrange(16):02d}") for g in "tuvw" for _ in range(19)]
    rows = frame(EDGES, *((f"e{i}", g, a, b, "CALLS", 1.0) for i, (g, a, b) in enumerate(links)))
    ahead = {}
    for start in {(g, x) for g, a, b in links for x in (a, b)}:
        seen, queue = set(), [start]
        while queue:
            g, node = queue.pop()
            fresh = {(g, b) for h, a, b in links if (h, a) == (g, node)} - seen
            seen |= fresh
            queue += fresh
        ahead[start] = seen
    expected = []
    for n, reached_from in ahead.items():
        same = {m for m in reached_from if n in ahead[m]} | {n}
        if len(same) > 1:
            expected.append((n[0], min(same)[1], n[1], len(same)))
    assert tuples(components(forward_of(rows, ["CALLS"]))) == sorted(expected, key=repr)
    assert tuples(components(forward_of(rows, ["CALLS"]), local_links=0)) == sorted(expected, key=repr)
    assert {size for g, _, _, size in expected if g == "s"} == {2, 11}
    assert tuples(components(forward_of(edges(frame), ["CALLS"]))) == []


def test_causal_paths_and_degrees(frame):
    rows = edges(frame, ("A", "B", "CALLS"), ("B", "C", "USES"), ("C", "D", "CALLS"), ("D", "E", "CALLS"), ("E", "F", "CALLS"), ("A", "B", "IMPORTS"))
    pairs = frame("graph string, root string, target string", ("s", "A", "D"), ("s", "D", "B"), ("s", "A", "Z"), ("s", "A", "A"), ("s", "A", "F"), ("s", None, "A"), ("x", "A", "B"))
    found = causal_paths(pairs, all_forward(rows))
    assert tuples(found.select("root", "target", "hops", F.array_join("path", ""), "confidence")) == [("A", "A", 0, "A", 0.95), ("A", "D", 3, "ABCD", 0.66), ("D", "B", 2, "BCD", 0.74)]
    rows = edges(frame, ("A", "B", "CALLS"), ("C", "B", "USES"), ("C", "D", "CALLS"), ("A", "B", "IMPORTS"))
    assert tuples(degrees(rows)) == [("s", "A", 0, 1, 0, 2), ("s", "B", 2, 0, 3, 0), ("s", "C", 0, 2, 0, 2), ("s", "D", 1, 0, 1, 0)]


def test_confidence_is_rounded_at_every_hop_and_many_starts_make_one_traversal(frame):
    links = frame("graph string, src string, dst string, rel string, weight double", ("s", "A", "B", "CALLS", 0.33333), ("s", "B", "C", "CALLS", 0.33333), ("s", "D", "C", "CALLS", 1.0))
    assert tuples(reach(frame("graph string, root string", ("s", "A")), links, 3), "node", "confidence") == [("A", 1.0), ("B", 0.3333), ("C", 0.1111)]
    many = frame("graph string, root string, node string", ("s", "p", "A"), ("s", "p", "D"))
    assert tuples(reach(many, links, 3).select("root", "node", "depth", F.array_join("path", ""))) == [("p", "A", 0, "A"), ("p", "B", 1, "AB"), ("p", "C", 1, "DC"), ("p", "D", 0, "D")]


def test_placeholders(frame):
    node = "id string, artifact_type string, language string, name string, qualified_name string, location string, snapshot_id string"
    art = [("a1", "MODULE", "ts", "button", "src.ui.button", "src/ui/button.tsx:1", "s"), ("a2", "CLASS", "py", "Order", "shop.Order", "shop/order.py:3", "s"), ("a3", "CLASS", "py", "Twice", "x.Twice", "x/x.py:1", "s"), ("a4", "CLASS", "py", "Twice", "y.Twice", "y/y.py:1", "s")]
    ext = [("p1", "shop.Order"), ("p2", "@/ui/button"), ("p3", "Order"), ("p4", "Twice"), ("p5", "lib.models.Order"), ("p6", "nothing"), ("p7", "pkg/order")]
    outside = frame(node.replace(", snapshot_id string", ""), *((i, "EXTERNAL_DEPENDENCY", "x", q, q, "<external>") for i, q in ext))
    assert tuples(placeholder_map(frame(node, *art), outside), "placeholder", "concrete") == [("p1", "a2"), ("p2", "a1"), ("p3", "a2"), ("p5", "a2"), ("p7", "a2")]
