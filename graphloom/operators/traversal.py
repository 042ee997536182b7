"""Bounded traversals as level-synchronous frontier joins.

A level joins the frontier with the adjacency, keeps the best path per (graph, root, node) and drops nodes that
were reached before. Every level is checkpointed to the shared folder, so the plan stays one join deep and a lost
executor repeats one level. Nodes are taken once per root at their least depth; among shortest paths the one with
the smallest sequence of node ids wins, per hop the smallest relationship.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.session import checkpointed

#: Links up to which components are searched graph by graph instead of level by level.
LOCAL_LINKS = 500_000
REACHED = ["graph", "root", "node", "depth", "path", "rel", "confidence"]


def rounded(confidence: Column) -> Column:
    """To four places, as after every hop: half up over twelve decimals."""
    return F.round(confidence.cast("decimal(18,12)"), 4).cast("double")


def reach(roots: DataFrame, adjacency: DataFrame, max_depth: int | None) -> DataFrame:
    """Everything reached from ``roots`` within ``max_depth`` hops (None: any number), the roots at depth 0.

    Roots are ``graph, root``, or ``graph, root, node`` where one traversal named ``root`` starts from many nodes at once. Confidence is
    rounded at every hop. Cycles end at nodes already reached; roots that touch no edge reach themselves only; nulls are no roots.
    """
    if "node" not in roots.columns:
        roots = roots.withColumn("node", F.col("root"))
    start = roots.select("graph", "root", "node").where("graph is not null and root is not null and node is not null").distinct()
    frontier = checkpointed(start.select("graph", "root", "node", F.lit(0).alias("depth"), F.array("node").alias("path"), F.lit(None).cast("string").alias("rel"), F.lit(1.0).alias("confidence")))
    levels = [frontier]
    links = checkpointed(adjacency.select("graph", F.col("src").alias("node"), "dst", F.col("rel").alias("hop"), "weight"))
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        steps = frontier.join(links, ["graph", "node"]).where(~F.array_contains("path", F.col("dst")))
        best = F.min(F.struct(F.array_append("path", F.col("dst")).alias("path"), F.col("hop").alias("rel"), rounded(F.col("confidence") * F.col("weight")).alias("confidence")))
        found = steps.groupBy("graph", "root", "dst").agg(best.alias("b")).select("graph", "root", F.col("dst").alias("node"), F.lit(depth).alias("depth"), "b.path", "b.rel", "b.confidence")
        seen = reduce(DataFrame.unionByName, levels).select("graph", "root", "node")
        frontier = checkpointed(found.join(seen, ["graph", "root", "node"], "left_anti"))
        if frontier.isEmpty():
            break
        levels.append(frontier)
    return reduce(DataFrame.unionByName, levels)


def causal_paths(pairs: DataFrame, forward: DataFrame, max_hops: int = 4) -> DataFrame:
    """TRV-15: ``graph, root, target, hops, path, confidence`` for pairs of a changed node (``root``) and an incident's component (``target``).

    A shortest directed path from root to target, else from target to root, of at most ``max_hops`` links; a root that is the target itself has no
    link and confidence 0.95, the others ``max(0.5, 0.9 - 0.08 * hops)``. Both searches start from the few targets; of several shortest
    paths the one with the smallest ids from the target on counts.
    """
    wanted = pairs.select("graph", "root", "target").where("graph is not null and root is not null and target is not null").distinct()
    starts = wanted.select("graph", F.col("target").alias("root")).distinct()
    backward = forward.select("graph", F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", "weight")
    found = lambda links: reach(starts, links, max_hops).select("graph", F.col("root").alias("target"), F.col("node").alias("root"), F.col("depth").alias("hops"), "path")
    up = found(backward).withColumns({"way": F.lit(0), "path": F.reverse("path")})
    down = found(forward).withColumn("way", F.lit(1))
    best = wanted.join(up.unionByName(down), ["graph", "root", "target"]).groupBy("graph", "root", "target").agg(F.min(F.struct("way", "hops", "path")).alias("b"))
    hops = F.col("b.hops")
    confidence = F.when(hops == 0, 0.95).otherwise(F.greatest(F.lit(0.5), F.round(0.9 - 0.08 * hops, 2)))
    return best.select("graph", "root", "target", hops.alias("hops"), "b.path", confidence.alias("confidence"))


def cycles(adjacency: DataFrame, max_length: int | None = 4) -> DataFrame:
    """TRV-16: ``graph, length, path``: simple directed cycles of 2 to ``max_length`` nodes, each once, from its smallest id on.

    Paths start at their smallest node and only pass larger ones, so no rotation is built twice. Enumeration grows
    with the number of such paths; ``max_length`` bounds it. Without a bound all cycles are listed, along links within a
    component only, until no path is left; in dense components their number is exponential. Self-loops are no cycles here.
    """
    links = adjacency.select("graph", "src", "dst").distinct().where("src <> dst")
    if max_length is None:
        found = checkpointed(components(links))
        end = lambda name: found.select("graph", "component", F.col("node").alias(name))
        links = checkpointed(links.join(end("src"), ["graph", "src"]).join(end("dst"), ["graph", "component", "dst"]).select("graph", "src", "dst"))
    closing = links.where("dst < src").select("graph", F.col("src").alias("last"), F.col("dst").alias("first"))
    upward = links if max_length is None else checkpointed(links)
    paths = upward.where("dst > src").select("graph", F.col("src").alias("first"), F.col("dst").alias("last"), F.array("src", "dst").alias("path"))
    out = []
    for length in count(2) if max_length is None else range(2, max_length + 1):
        out.append(paths.join(closing, ["graph", "first", "last"]).select("graph", F.lit(length).alias("length"), "path"))
        if length != max_length:
            step = upward.select("graph", F.col("src").alias("last"), "dst")
            paths = paths.join(step, ["graph", "last"]).where((F.col("dst") > F.col("first")) & ~F.array_contains("path", F.col("dst"))).select("graph", "first", F.col("dst").alias("last"), F.array_append("path", F.col("dst")).alias("path"))
        if max_length is None:
            paths = checkpointed(paths)
            if paths.isEmpty():
                break
    return reduce(DataFrame.unionByName, out)


def _trimmed(links: DataFrame) -> DataFrame:
    """``links`` without those that lie on no cycle because nothing enters their source or leaves their target; may keep links between cycles."""
    left = None
    while left != 0:
        entered = links.select("graph", F.col("dst").alias("src")).distinct()
        going = links.select("graph", F.col("src").alias("dst")).distinct()
        links = checkpointed(links.join(entered, ["graph", "src"], "left_semi").join(going, ["graph", "dst"], "left_semi").select("graph", "src", "dst"))
        before, left = left, links.count()
        if left == before:
            break
    return links.distinct()


def _strong(pdf: pd.DataFrame) -> pd.DataFrame:
    """Strongly connected components of two nodes or more of one graph, by depth-first search with an explicit stack."""
    ahead: dict[str, list[str]] = {}
    for a, b in zip(pdf["src"], pdf["dst"], strict=True):
        ahead.setdefault(a, []).append(b)
    number: dict[str, int] = {}
    low: dict[str, int] = {}
    open_nodes: list[str] = []
    is_open: set[str] = set()
    rows = []
    for start in ahead:
        if start in number:
            continue
        number[start] = low[start] = len(number)
        open_nodes.append(start)
        is_open.add(start)
        work = [(start, iter(ahead[start]))]
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in number:
                    number[other] = low[other] = len(number)
                    open_nodes.append(other)
                    is_open.add(other)
                    work.append((other, iter(ahead.get(other, ()))))
                    break
                if other in is_open:
                    low[node] = min(low[node], number[other])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == number[node]:
                    members = []
                    while True:
                        members.append(open_nodes.pop())
                        is_open.discard(members[-1])
                        if members[-1] == node:
                            break
                    if len(members) > 1:
                        rows += [(pdf["graph"].iloc[0], min(members), m, len(members)) for m in members]
    return pd.DataFrame(rows, columns=["graph", "component", "node", "size"])


def components(adjacency: DataFrame, local_links: int = LOCAL_LINKS) -> DataFrame:
    """TRV-16: ``graph, component, node, size`` of the nodes on directed cycles of any length; a component has the name of its smallest node.

    Exact: components are strongly connected and have 2 nodes or more. If all graphs together have at most ``local_links`` links (counted first, so no graph has more), each graph
    is searched in one place. Otherwise, with the same result: after links on no cycle are trimmed, every node takes the
    smallest node that reaches it, level by level; the nodes that lead back to this name within it are one component. They leave, and
    the rest is done again until no link is left. Each step is one checkpointed join; steps grow with the longest path, not with the number of cycles.
    """
    links = adjacency.select("graph", "src", "dst").where("graph is not null and src <> dst")
    if local_links:
        links = checkpointed(links.distinct())
        if links.limit(local_links + 1).count() <= local_links:
            return links.groupBy("graph").applyInPandas(_strong, "graph string, component string, node string, size bigint")
    empty = links.select("graph", F.col("src").alias("component"), F.col("src").alias("node"), F.lit(0).cast("bigint").alias("size")).limit(0)
    out = [empty]
    while not (links := checkpointed(_trimmed(links))).isEmpty():
        labels = checkpointed(links.select("graph", F.col("src").alias("node"), F.col("src").alias("component")).unionByName(links.select("graph", F.col("dst").alias("node"), F.col("dst").alias("component"))).distinct())
        moved = labels
        while not moved.isEmpty():
            offers = moved.withColumnRenamed("node", "src").join(links, ["graph", "src"]).groupBy("graph", F.col("dst").alias("node")).agg(F.min("component").alias("offer"))
            state = checkpointed(labels.join(offers, ["graph", "node"], "left").select("graph", "node", F.least("component", "offer").alias("component"), (F.col("offer") < F.col("component")).alias("moved")))
            labels, moved = state.select("graph", "node", "component"), state.where("moved").select("graph", "node", "component")
        of = lambda end: labels.withColumnsRenamed({"node": end, "component": f"{end}_component"})
        links = checkpointed(links.join(of("src"), ["graph", "src"]).join(of("dst"), ["graph", "dst"]).where("src_component = dst_component").select("graph", "src", "dst", F.col("src_component").alias("component")))
        frontier = labels.where("node = component").select("graph", "component", "node")
        levels = [frontier]
        while True:
            back = frontier.withColumnRenamed("node", "dst").join(links, ["graph", "component", "dst"]).select("graph", "component", F.col("src").alias("node")).distinct()
            frontier = checkpointed(back.join(reduce(DataFrame.unionByName, levels), ["graph", "component", "node"], "left_anti"))
            if frontier.isEmpty():
                break
            levels.append(frontier)
        found = checkpointed(reduce(DataFrame.unionByName, levels))
        sizes = found.groupBy("graph", "component").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        out.append(found.join(sizes, ["graph", "component"]).select("graph", "component", "node", "size"))
        gone = lambda end: found.select("graph", F.col("node").alias(end))
        links = links.join(gone("src"), ["graph", "src"], "left_anti").join(gone("dst"), ["graph", "dst"], "left_anti").select("graph", "src", "dst")
        links = checkpointed(links)
    return reduce(DataFrame.unionByName, out)


def plain_links(edges: DataFrame, types: list[str]) -> DataFrame:
    """Ends of the edges of the given types, not made distinct: records that come twice do not matter for components."""
    return edges.where(F.upper("relationship_type").isin(types)).select(F.col("snapshot_id").alias("graph"), F.col("source_artifact_id").alias("src"), F.col("target_artifact_id").alias("dst"))


def undirected(edges: DataFrame) -> DataFrame:
    """Adjacency in both directions, for ego networks."""
    base = edges.select(F.col("snapshot_id").alias("graph"), F.col("source_artifact_id").alias("a"), F.col("target_artifact_id").alias("b")).where("a <> b")
    both = base.select("graph", F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(base.select("graph", F.col("b").alias("src"), F.col("a").alias("dst")))
    return both.distinct().withColumns({"rel": F.lit("LINK"), "weight": F.lit(1.0)})


def reversed_all(edges: DataFrame) -> DataFrame:
    """Every edge from target to source, whatever its type (blast radius)."""
    base = edges.select(F.col("snapshot_id").alias("graph"), F.col("target_artifact_id").alias("src"), F.col("source_artifact_id").alias("dst"), F.upper("relationship_type").alias("rel")).where("src <> dst")
    return base.groupBy("graph", "src", "dst").agg(F.min("rel").alias("rel")).withColumn("weight", F.lit(1.0))


def all_forward(edges: DataFrame) -> DataFrame:
    """Every edge from source to target, whatever its type (call chains)."""
    base = edges.select(F.col("snapshot_id").alias("graph"), F.col("source_artifact_id").alias("src"), F.col("target_artifact_id").alias("dst")).where("src <> dst")
    return base.distinct().withColumns({"rel": F.lit("LINK"), "weight": F.lit(1.0)})


def forward_of(edges: DataFrame, types: list[str]) -> DataFrame:
    """Edges of the given types from source to target."""
    base = edges.select(F.col("snapshot_id").alias("graph"), F.col("source_artifact_id").alias("src"), F.col("target_artifact_id").alias("dst"), F.upper("relationship_type").alias("rel"))
    return base.where(F.col("rel").isin(types) & (F.col("src") != F.col("dst"))).groupBy("graph", "src", "dst").agg(F.min("rel").alias("rel")).withColumn("weight", F.lit(1.0))
