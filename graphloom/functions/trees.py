"""Edit distance between unordered labelled trees whose leaves carry the content.

The constrained edit distance: disjoint subtrees are mapped to disjoint subtrees, children of two mapped nodes are
paired by a minimum-cost matching, and a node may be put between a node and its children or taken away from there. Time is
polynomial in the sizes, where the unconstrained distance of unordered trees is NP-hard.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np

LEAF, INNER = 1.0, 0.1
#: Joins the labels of a path; a label holds any other character.
SEPARATOR = "\x1f"


class Node:
    """A node with its path from the root; leaves have no children and ``leaf`` set."""

    __slots__ = ("path", "label", "children", "leaf", "weight")

    def __init__(self, path: str, leaf: bool):
        self.path, self.label, self.leaf = path, path.rpartition(SEPARATOR)[2], leaf
        self.children: list[Node] = []
        self.weight = 0.0

    def weigh(self) -> float:
        """Cost of deleting or adding the whole subtree."""
        self.weight = LEAF if self.leaf else INNER + sum(c.weigh() for c in self.children)
        return self.weight


def tree(leaves: Iterable[str], inner: Iterable[str] = ()) -> Node:
    """The tree of leaf paths; a path that is also the beginning of another gives a leaf beside the inner node."""
    root = Node("", False)
    nodes = {"": root}

    def inner_node(path: str) -> Node:
        missing = []
        while path not in nodes:
            missing.append(path)
            path = path.rpartition(SEPARATOR)[0]
        at = nodes[path]
        for p in reversed(missing):
            nodes[p] = Node(p, False)
            at.children.append(nodes[p])
            at = nodes[p]
        return at

    for path in sorted(inner):
        inner_node(path)
    for path in sorted(leaves):
        inner_node(path.rpartition(SEPARATOR)[0] if SEPARATOR in path else "").children.append(Node(path, True))
    root.weigh()
    return root


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost matching of rows and columns by shortest augmenting paths; every row or every column is matched."""
    flipped = cost.shape[0] > cost.shape[1]
    c = cost.T if flipped else cost
    n, m = c.shape
    u, v, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=bool)
        while match[j] != 0:
            used[j] = True
            row = match[j]
            reduced = np.concatenate([[np.inf], c[row - 1] - u[row] - v[1:]])
            better = ~used & (reduced < least)
            least[better], way[better] = reduced[better], j
            nearest = int(np.argmin(np.where(used, np.inf, least)))
            delta = least[nearest]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = nearest
        while j:
            match[j], j = match[way[j]], way[j]
    pairs = [(match[k] - 1, k - 1) for k in range(1, m + 1) if match[k]]
    return [(b, a) for a, b in pairs] if flipped else pairs


def mapping(old: Node, new: Node, relabel: Callable[[str, str], float]) -> tuple[float, list[tuple[Node, Node]]]:
    """The distance and the mapped nodes of a cheapest edit; ``relabel`` is the cost of turning a leaf into another.

    Deleting or adding a leaf costs 1, an inner node 0.1, and so does a new label of an inner node.
    """
    trees: dict[tuple[int, int], tuple[float, list]] = {}
    forests: dict[tuple[int, int], tuple[float, list]] = {}

    def put(a: Node, b: Node) -> tuple[float, list] | None:
        """``a`` goes on below a new node ``b``."""
        options = [(between(a, c)[0] - c.weight, i) for i, c in enumerate(b.children)]
        if not options:
            return None
        gain, i = min(options)
        return gain + b.weight, between(a, b.children[i])[1]

    def take(a: Node, b: Node) -> tuple[float, list] | None:
        """What is below ``a`` goes on as ``b``."""
        options = [(between(c, b)[0] - c.weight, i) for i, c in enumerate(a.children)]
        if not options:
            return None
        gain, i = min(options)
        return gain + a.weight, between(a.children[i], b)[1]

    def between(a: Node, b: Node) -> tuple[float, list]:
        key = id(a), id(b)
        if key not in trees:
            options: list[tuple[float, list] | None] = [(a.weight + b.weight, [])]
            if a.leaf and b.leaf:
                options.append((relabel(a.path, b.path), [(a, b)]))
            elif not a.leaf and not b.leaf:
                cost, pairs = below(a, b)
                options.append((cost + INNER * (a.label != b.label), [(a, b), *pairs]))
            options += [put(a, b), take(a, b)]
            trees[key] = min((o for o in options if o is not None), key=lambda o: o[0])
        return trees[key]

    def below(a: Node, b: Node) -> tuple[float, list]:
        key = id(a), id(b)
        if key not in forests:
            gone, come = sum(c.weight for c in a.children), sum(c.weight for c in b.children)
            best = (gone + come, [])
            if a.children and b.children:
                gain = np.array([[min(0.0, between(x, y)[0] - x.weight - y.weight) for y in b.children] for x in a.children])
                pairs = [(a.children[i], b.children[j]) for i, j in assignment(gain) if gain[i, j] < 0]
                best = min(best, (gone + come + sum(between(x, y)[0] - x.weight - y.weight for x, y in pairs), [p for x, y in pairs for p in between(x, y)[1]]), key=lambda o: o[0])
            for y in b.children:  # all children go on below one new node
                if not y.leaf and y.children and len(a.children) > 1:
                    cost, found = below(a, y)
                    best = min(best, (cost - (y.weight - INNER) + come, found), key=lambda o: o[0])
            for x in a.children:
                if not x.leaf and x.children and len(b.children) > 1:
                    cost, found = below(x, b)
                    best = min(best, (cost - (x.weight - INNER) + gone, found), key=lambda o: o[0])
            forests[key] = best
        return forests[key]

    cost, pairs = below(old, new)
    return cost, [(old, new), *pairs]
