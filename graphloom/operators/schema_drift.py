"""Problem 1: schemas that drift between files.

Every file's attributes are a tree of objects whose leaves are fields. Consecutive trees of a feed are compared
by tree edit distance (``functions/trees.py``): a path in both is free, deleting or adding a field costs 1, and turning one
field into another costs the less the more their names and their values are alike. What a field's values look like is learned from
all lines: per path a vector of hashed traits (words and shapes of the values), so that a field that changes name and
type at once is still known by the values it has elsewhere. No list of names is used. The cheapest
script (add, delete, rename, move, retype; of fields and of objects) folds along a feed into one projection per file, which is applied to every line.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.names import similarity, words
from graphloom.functions.trees import INNER, SEPARATOR, Node, assignment, mapping, tree
from graphloom.session import bounded_broadcast, checkpointed

#: Length of a trait vector. Rarer traits than LEAST of a path's values are left out of it, so it has at most a few hundred entries.
BUCKETS = 1024
LEAST = 0.005
#: Traits of one file's field that are kept (those with the smallest hashes), for names that few files know.
SKETCH = 16
#: Files that must know both names before the learned values alone decide.
KNOWN_FILES = 8
_FLUSH = 50_000
_PART = "feed_id string, file_no int, path string, kind string, bucket int, n bigint, sketch array<bigint>"
_WORD = re.compile(r"[^\W_]+")
_RUN = re.compile(r"(.)\1+", re.S)
_SHAPE = {**{ord(c): "9" for c in "0123456789"}, **{ord(c): "a" for c in "abcdefghijklmnopqrstuvwxyz"}}


def parse_line(line: str | None) -> dict | None:
    """The event of a line, or None if it cannot be read."""
    try:
        event = json.loads(line) if line else None
    except (ValueError, RecursionError):
        return None
    return event if isinstance(event, dict) else None


def leaves(attributes: dict) -> Iterator[tuple[str, object]]:
    """``(path, value)`` of the leaves that are not null; names on a path are joined by SEPARATOR. A leaf without any name is none."""
    stack = [(str(k), v) for k, v in attributes.items()]
    while stack:
        path, value = stack.pop()
        if isinstance(value, dict):
            stack.extend((f"{path}{SEPARATOR}{k}", v) for k, v in value.items())
        elif value is not None and path:
            yield path, value


def dotted(path: str) -> str:
    return path.replace(SEPARATOR, ".")


def kind(value: object) -> str:
    """One of the four types of a field."""
    if isinstance(value, bool):
        return "boolean"
    return "string" if isinstance(value, str) else "list" if isinstance(value, list) else "number"


def traits(value: object) -> frozenset[int]:
    """Hashed traits of a whole value that mostly survive a change of type: its words and its shape."""
    flat, stack = [], [value]
    while stack:
        part = stack.pop()
        if isinstance(part, list):
            stack.extend(part)
        elif isinstance(part, dict):
            stack.extend(part.values())
        elif part is not None:
            flat.append(str(part).lower())
    text = " ".join(flat)
    found = {f"w{w}" for w in _WORD.findall(text)}
    shape = text.translate(_SHAPE)
    found.add("m" + (shape if not shape.strip("9") else _RUN.sub(r"\1", shape)))
    return frozenset(xxhash.xxh64_intdigest(t) >> 1 for t in found)


def _profile(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fields by file (bucket -1), and trait counts by path, combined as far as they are read."""
    fields: dict[tuple, list] = {}
    counts: dict[tuple[str, frozenset[int]], int] = {}
    memory: dict[object, frozenset[int]] = {}

    def flush() -> pd.DataFrame:
        rows = [(*k, -1, n, sorted(s)[:SKETCH]) for k, (n, s) in fields.items()]
        vectors: dict[str, np.ndarray] = {}
        for (path, hashes), n in counts.items():
            vector = vectors.get(path)
            if vector is None:
                vector = vectors[path] = np.zeros(BUCKETS, dtype=np.int64)
            for b in {h % BUCKETS for h in hashes}:
                vector[b] += n
        rows += [(None, None, p, None, int(b), int(v[b]), None) for p, v in vectors.items() for b in np.flatnonzero(v)]
        fields.clear()
        counts.clear()
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _PART.split(", ")]).astype({"file_no": "Int32"})

    for batch in batches:
        for feed, file_no, line in zip(batch["feed_id"], batch["file_no"], batch["line"], strict=True):
            event = parse_line(line)
            if event is None:
                continue
            fields.setdefault((feed, file_no, "", "file"), [0, set()])[0] += 1
            attributes = event.get("attributes")
            for path, value in leaves(attributes) if isinstance(attributes, dict) else ():
                of = kind(value)
                key = (of, value if of != "list" else repr(value))
                hashes = memory.get(key)
                if hashes is None:
                    if len(memory) > _FLUSH:
                        memory.clear()
                    hashes = memory[key] = traits(value)
                told = (path, hashes)
                counts[told] = counts.get(told, 0) + 1
                entry = fields.get((feed, file_no, path, of))
                if entry is None:
                    entry = fields[feed, file_no, path, of] = [0, set()]
                entry[0] += 1
                if not hashes <= entry[1]:
                    entry[1] |= hashes
                    if len(entry[1]) > 8 * SKETCH:
                        entry[1] = set(sorted(entry[1])[:SKETCH])
        if len(fields) > _FLUSH or len(counts) > 4 * _FLUSH:
            yield flush()
    if fields:
        yield flush()


def profiles(lines: DataFrame) -> DataFrame:
    """Merged counts of fields by file and of traits by path, from which schemas and vectors are read; keep it with ``checkpointed``.

    Sums and smallest hashes merge exactly, so hot feeds are combined where they are read. Lines without feed or file number are left out.
    """
    rows = lines.select("feed_id", F.col("file_no").cast("int").alias("file_no"), "line").where("feed_id is not null and file_no is not null and line is not null")
    parts = rows.mapInPandas(_profile, _PART)
    smallest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, SKETCH)
    return parts.groupBy("feed_id", "file_no", "path", "kind", "bucket").agg(F.sum("n").alias("n"), smallest.alias("sketch"))


def file_schemas(profiled: DataFrame) -> DataFrame:
    """``feed_id, file_no, fields``: the fields of each file with at least one readable line.

    ``fields`` is an array of ``(path, kind, n, sketch)``, as wide as the schema. A path seen with several types has the most frequent one.
    """
    single = profiled.where("bucket = -1").groupBy("feed_id", "file_no", "path").agg(F.max(F.struct("n", "kind", "sketch")).alias("m"))
    return single.groupBy("feed_id", "file_no").agg(F.collect_list(F.when(F.col("path") != "", F.struct("path", F.col("m.kind").alias("kind"), F.col("m.n").alias("n"), F.col("m.sketch").alias("sketch")))).alias("fields"))


def path_vectors(profiled: DataFrame) -> DataFrame:
    """``path, n_files, vector``: per path the share of its values with a trait, weighted by how few paths have the trait."""
    own = profiled.where("bucket = -1 and path <> ''").groupBy("path").agg(F.sum("n").alias("_values"), F.count_distinct("feed_id", "file_no").alias("n_files"))
    shares = profiled.where("bucket >= 0").join(own, "path").where(F.col("n") >= LEAST * F.col("_values")).select("path", "n_files", "bucket", (F.col("n") / F.col("_values")).alias("share"))
    # one row per bucket: 1,024 at most
    spread = F.broadcast(shares.groupBy("bucket").agg(F.count(F.lit(1)).alias("_paths")))
    paths = own.agg(F.count(F.lit(1)).alias("_all"))
    weighted = shares.join(spread, "bucket").select("path", "n_files", "bucket", "share", "_paths", paths.scalar().alias("_all"))
    value = (F.col("share") * F.log1p(F.col("_all") / F.col("_paths"))).cast("float")
    return weighted.groupBy("path", "n_files").agg(F.map_from_entries(F.collect_list(F.struct("bucket", value.alias("w")))).alias("vector"))


class Field:
    """What is known of one field of a file."""

    __slots__ = ("kind", "sketch", "n_files", "vector", "norm")

    def __init__(self, kind: str, sketch: set[int], n_files: int = 0, vector: dict[int, float] | None = None):
        self.kind, self.sketch, self.n_files, self.vector = kind, sketch, n_files, vector or {}
        self.norm = float(np.sqrt(sum(w * w for w in self.vector.values())))


def values_alike(a: Field, b: Field) -> float:
    """Cosine of the learned vectors; where too few files know one of the names, at least the overlap of the two files' own values."""
    small, large = sorted((a.vector, b.vector), key=len)
    cosine = sum(w * large.get(k, 0.0) for k, w in small.items()) / (a.norm * b.norm) if a.norm and b.norm else 0.0
    if min(a.n_files, b.n_files) >= KNOWN_FILES:
        return cosine
    return max(cosine, len(a.sketch & b.sketch) / max(1, min(len(a.sketch), len(b.sketch))))


def relabel_cost(old: str, new: str, before: Field, after: Field) -> float:
    """0 for a field that surely goes on, 2 (as much as to delete and to add) for one that does not."""
    value = min(1.0, max(0.0, (values_alike(before, after) - 0.5) / 0.35))
    name = max(similarity(old.replace(SEPARATOR, "_"), new.replace(SEPARATOR, "_")), similarity(old.rpartition(SEPARATOR)[2], new.rpartition(SEPARATOR)[2]))
    return 2 * (1 - value) * (1 - 0.6 * name) + 0.02 * (before.kind != after.kind)


def edit_script(before: dict[str, Field], after: dict[str, Field]) -> list[tuple[str, str, str | None, str | None]]:
    """``(operation, node, path before, path after)`` of a cheapest script from one schema to the next.

    Operations are ``add, delete, rename, move, retype`` of a ``field`` or an ``object``. A node keeps its identity under the same path. What the
    tree mapping leaves over on both sides is compared once more over the whole tree, as a field may move between objects that stay.
    """
    inner = lambda paths: {p.rsplit(SEPARATOR, k)[0] for p in paths for k in range(1, p.count(SEPARATOR) + 1)}
    gone, come = sorted(before.keys() - after.keys()), sorted(after.keys() - before.keys())
    objects_before, objects_after = inner(before), inner(after)
    both = objects_before & objects_after
    cost = lambda a, b: relabel_cost(a, b, before[a], after[b])
    pairs: list[tuple[str, str]] = []
    image: dict[str, str] = {p: p for p in both} | {"": ""}
    if gone and come:
        _, mapped = mapping(tree(gone, {p for p in both if any(g.startswith(p + SEPARATOR) for g in gone)}), tree(come, {p for p in both if any(c.startswith(p + SEPARATOR) for c in come)}), cost)
        pairs = [(a.path, b.path) for a, b in mapped if a.leaf and cost(a.path, b.path) < 1]
        for a, b in mapped:
            if not a.leaf and a.path not in both and b.path not in both:
                image[a.path] = b.path
        left, right = [g for g in gone if g not in {a for a, _ in pairs}], [c for c in come if c not in {b for _, b in pairs}]
        if left and right:
            moved = np.array([[min(2.0, cost(g, c) + INNER) for c in right] for g in left])
            pairs += [(left[i], right[j]) for i, j in assignment(moved) if moved[i, j] < 1]
    up = lambda p: p.rpartition(SEPARATOR)[0]
    label = lambda p: p.rpartition(SEPARATOR)[2]
    out: list[tuple[str, str, str | None, str | None]] = []
    for node, found in (("object", [(a, b) for a, b in image.items() if a != b]), ("field", pairs)):
        for a, b in sorted(found):
            if label(a) != label(b):
                out.append(("rename", node, a, b))
            if image.get(up(a)) != up(b):
                out.append(("move", node, a, b))
            elif node == "field" and label(a) == label(b):
                out.append(("carry", node, a, b))  # its object has a new name or place
    out += [("delete", "object", p, None) for p in sorted(objects_before - objects_after - image.keys())]
    out += [("add", "object", None, p) for p in sorted(objects_after - objects_before - set(image.values()))]
    out += [("delete", "field", g, None) for g in gone if g not in {a for a, _ in pairs}]
    out += [("add", "field", None, c) for c in come if c not in {b for _, b in pairs}]
    out += [("retype", "field", a, b) for a, b in [*pairs, *((p, p) for p in sorted(before.keys() & after.keys()))] if before[a].kind != after[b].kind]
    return out


def _fields(rows: object, vectors: dict[str, tuple[int, dict[int, float]]]) -> dict[str, Field]:
    return {r["path"]: Field(r["kind"], set(r["sketch"]), *vectors.get(r["path"], (0, {}))) for r in rows} if rows is not None else {}


def _scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for feed, file_no, old, new, known in zip(batch["feed_id"], batch["file_no"], batch["old"], batch["new"], batch["vectors"], strict=True):
            vectors = {k["path"]: (k["n_files"], dict(k["vector"])) for k in known} if known is not None else {}
            rows += [(feed, file_no, *step) for step in edit_script(_fields(old, vectors), _fields(new, vectors))]
        yield pd.DataFrame(rows, columns=["feed_id", "file_no", "operation", "node", "path_before", "path_after"])


def schema_scripts(schemas: DataFrame, vectors: DataFrame) -> DataFrame:
    """``feed_id, file_no, operation, node, path_before, path_after`` from each file's predecessor, numbered one lower, to the file.

    Only names that leave or enter, where both happen, are looked up among the vectors. Files without a readable predecessor are not compared.
    """
    old = schemas.select("feed_id", (F.col("file_no") + 1).alias("file_no"), F.col("fields").alias("old"))
    pairs = schemas.select("feed_id", "file_no", F.col("fields").alias("new")).join(old, ["feed_id", "file_no"])
    names = lambda c: F.transform(c, lambda f: f["path"])
    gone, come = F.array_except(names("old"), names("new")), F.array_except(names("new"), names("old"))
    asked = pairs.where((F.size(gone) > 0) & (F.size(come) > 0)).select("feed_id", "file_no", F.explode(F.array_union(gone, come)).alias("path"))
    known = asked.join(bounded_broadcast(vectors), "path").groupBy("feed_id", "file_no").agg(F.collect_list(F.struct("path", "n_files", "vector")).alias("vectors"))
    rows = pairs.join(known, ["feed_id", "file_no"], "left").select("feed_id", "file_no", "old", "new", "vectors")
    return rows.mapInPandas(_scripts, "feed_id string, file_no int, operation string, node string, path_before string, path_after string")


def schema_changes(scripts: DataFrame) -> DataFrame:
    """``feed_id, file_no, field_name, change, former_name`` of the fields, from the scripts.

    A field that was renamed or moved, itself or with its object, is ``renamed``. Repeated deliveries and lines change nothing; lines
    that cannot be read, or whose attributes are no object, give no fields; empty input gives no rows. Paths that look alike
    with dots between their names are one field.
    """
    kinds = {"add": "added", "delete": "removed", "retype": "retyped"}
    change = F.lit("renamed")
    for operation, name in kinds.items():
        change = F.when(F.col("operation") == operation, name).otherwise(change)
    dots = lambda c: F.translate(c, SEPARATOR, ".")
    rows = scripts.where("node = 'field'").select("feed_id", "file_no", dots(F.coalesce("path_after", "path_before")).alias("field_name"), change.alias("change"), dots("path_before").alias("former_name"))
    return rows.where((F.col("change") != "renamed") | (F.col("field_name") != F.col("former_name"))).distinct()


def drift(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Schemas and scripts of event lines, from one reading of them."""
    profiled = checkpointed(profiles(lines))
    schemas = file_schemas(profiled)
    return schemas, schema_scripts(schemas, path_vectors(profiled))


def common_names(schemas: DataFrame, scripts: DataFrame, rounds: int = 4) -> DataFrame:
    """``path, common``: one name for all paths that feeds rename into each other, the one that most files have.

    A rename counts as a link if at least a hundredth as many files show it as have the rarer name. Names spread along links for ``rounds`` steps.
    """
    count = schemas.select(F.explode("fields").alias("f")).groupBy(F.col("f.path").alias("path")).agg(F.count(F.lit(1)).alias("n"))
    renamed = scripts.where("node = 'field' and path_before is not null and path_after is not null and path_before <> path_after").groupBy("path_before", "path_after").agg(F.count(F.lit(1)).alias("links"))
    a, b = count.select(F.col("path").alias("path_before"), F.col("n").alias("n0")), count.select(F.col("path").alias("path_after"), F.col("n").alias("n1"))
    links = renamed.join(a, "path_before").join(b, "path_after").where(F.col("links") >= 0.01 * F.least("n0", "n1"))
    links = checkpointed(links.select(F.col("path_before").alias("path"), F.col("path_after").alias("other")).union(links.select("path_after", "path_before")).distinct())
    named = count.select("path", F.struct("n", "path").alias("best"))
    for _ in range(rounds):
        reached = links.join(named, "path").select(F.col("other").alias("path"), "best")
        named = checkpointed(named.union(reached).groupBy("path").agg(F.max("best").alias("best")))
    return named.select("path", F.col("best.path").alias("common"))


def common_kind(kinds: set[str]) -> str:
    """The type that values of several types are brought to: a list if any is one, else text, else numbers."""
    for k in ("list", "string", "number"):
        if k in kinds and len(kinds) > 1:
            return k
    return next(iter(kinds), "string")


def _project_feed(pdf: pd.DataFrame) -> pd.DataFrame:
    files, current = [], {}
    kinds: dict[str, set[str]] = {}
    for feed, file_no, fields, renames in pdf.sort_values("file_no")[["feed_id", "file_no", "fields", "renames"]].itertuples(index=False):
        former = {r["path_after"]: r["path_before"] for r in renames} if renames is not None else {}
        current = {f["path"]: current.get(former.get(f["path"], f["path"])) or "_".join(words(f["common"])) or f["path"] for f in fields}
        taken: dict[str, str] = {}
        for path in sorted(current):
            field, n = current[path], 2
            while field in taken:
                field, n = f"{current[path]}_{n}", n + 1
            taken[field] = path
        for f in fields:
            kinds.setdefault(next(k for k, p in taken.items() if p == f["path"]), set()).add(f["kind"])
        files.append((feed, file_no, {p: f for f, p in taken.items()}))
    rows = [(feed, file_no, {p: (f, common_kind(kinds[f])) for p, f in names.items()}) for feed, file_no, names in files]
    return pd.DataFrame([(a, b, [(p, *to) for p, to in c.items()]) for a, b, c in rows], columns=["feed_id", "file_no", "projection"])


def projections(schemas: DataFrame, scripts: DataFrame) -> DataFrame:
    """``feed_id, file_no, projection``: ``(path, field, kind)`` of each field of a file, carried along each feed's renames.

    A group here is the list of a feed's file schemas (metadata), never its lines. ``kind`` is one type for the whole feed.
    """
    renames = scripts.where("node = 'field' and operation in ('rename', 'move', 'carry')").groupBy("feed_id", "file_no").agg(F.collect_set(F.struct("path_after", "path_before")).alias("renames"))
    fields = schemas.select("feed_id", "file_no", F.explode_outer("fields").alias("f")).select("feed_id", "file_no", F.col("f.path").alias("path"), F.col("f.kind").alias("kind"))
    named = fields.join(bounded_broadcast(common_names(schemas, scripts)), "path", "left").groupBy("feed_id", "file_no").agg(F.collect_list(F.when(F.col("path").isNotNull(), F.struct("path", "kind", "common"))).alias("fields"))
    return named.join(renames, ["feed_id", "file_no"], "left").groupBy("feed_id").applyInPandas(_project_feed, "feed_id string, file_no int, projection array<struct<path: string, field: string, kind: string>>")


def _text(value: object) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def as_kind(value: object, of: str) -> object:
    """A value brought to the common type of its field."""
    if of == "list":
        return [_text(v) for v in (value if isinstance(value, list) else [value])]
    if of == "number":
        return float(value)  # numbers and booleans only come here
    return value if of == "boolean" else _text(value)


_HEAD = ["timestamp", "event_type", "service", "severity", "message"]
_MAPS = {"string": "texts", "number": "numbers", "boolean": "flags", "list": "lists"}


@lru_cache(maxsize=1024)
def _targets(projection: str | None) -> dict[str, tuple[str, str]]:
    return {p["path"]: (p["field"], p["kind"]) for p in json.loads(projection or "[]")}


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for feed, file_no, line_no, line, projection in batch[["feed_id", "file_no", "line_no", "line", "projection"]].itertuples(index=False):
            event = parse_line(line)
            if event is None:
                continue
            to = _targets(projection)
            maps: dict[str, dict] = {k: {} for k in _MAPS}
            attributes = event.get("attributes")
            for path, value in leaves(attributes) if isinstance(attributes, dict) else ():
                field, of = to.get(path, (None, None))
                if field is not None:
                    try:
                        maps[of][field] = as_kind(value, of)
                    except (TypeError, ValueError, OverflowError):
                        maps["string"][field] = _text(value)
            rows.append((feed, file_no, line_no, *(_text(event.get(h)) for h in _HEAD), *maps.values()))
        yield pd.DataFrame(rows, columns=["feed_id", "file_no", "line_no", *_HEAD, *_MAPS.values()])


def consistent_table(lines: DataFrame, plan: DataFrame) -> DataFrame:
    """Every readable line once, its attributes under the common fields in one map per type: ``texts, numbers, flags, lists``.

    A field is in the same map for all lines of a feed; where its type changed, values are brought to lists (one value makes a list
    of one), else to text (JSON), else to numbers (true is 1). Of a line delivered several times the one with the smallest text is
    kept, readable before unreadable; nulls are left out of the maps.
    """
    rows = lines.select("feed_id", F.col("file_no").cast("int").alias("file_no"), "line_no", "line").where("line is not null")
    types = "texts map<string,string>, numbers map<string,double>, flags map<string,boolean>, lists map<string,array<string>>"
    made = rows.join(bounded_broadcast(plan.withColumn("projection", F.to_json("projection"))), ["feed_id", "file_no"]).mapInPandas(_apply, f"feed_id string, file_no int, line_no int, timestamp string, event_type string, service string, severity string, message string, {types}")
    maps = list(_MAPS.values())
    flat = made.withColumns({m: F.array_sort(F.map_entries(m)) for m in maps})
    kept = flat.groupBy("feed_id", "file_no", "line_no").agg(F.min(F.struct(*_HEAD, *maps)).alias("r"))
    return kept.select("feed_id", "file_no", "line_no", *(F.col(f"r.{h}") for h in _HEAD), *(F.map_from_entries(f"r.{m}").alias(m) for m in maps))
