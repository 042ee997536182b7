"""Problem 7: filling fixed-capacity containers with texts.

Texts are measured in tokens of a public tokenizer. A text over the capacity is cut into full pieces and a
rest; everything else stays whole. Items are brought into an order in which likely neighbours stand close (by min-hashes of their most
repeated terms) and the order is cut into shards of bounded size. Each shard holds a BM25 inverted index of its items, with document
frequencies, term frequencies and lengths over all documents: a container starts with the largest unused item as seed, the index returns its
unused neighbours, and those that fit are taken in order of score; when the room is small, the best-fitting of the CHOICE best neighbours that fit.
Only when no neighbour that shares a term fits, any other item does. Items of containers that stay underfull are packed once more in fewer shards.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import checkpointed

#: Terms of the index are token ids, so the document frequencies are one number per entry of the vocabulary at any input size.
TERMS = 1 << 18
#: Tokens per shard, in containers. Bounds a shard's memory whatever the input.
CONTAINERS_PER_SHARD = 256
ITEMS_PER_SHARD = 4_096
K1, B = 1.2, 0.75
#: Share of the capacity below which room is small, and neighbours among which the best-fitting then is taken.
SMALL, CHOICE = 0.3, 48
#: A text's most repeated terms that make its place in the order, the token ids below which terms tell nothing (single bytes; a tokenizer numbers its
#: tokens by falling frequency), and min-hashes kept.
TELLING, COMMON, HASHES = 16, 256, 4
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ITEM = "doc_id bigint, piece_no int, token_start bigint, n_tokens bigint, terms array<int>, counts array<int>, place array<bigint>"
_PLACED = "container_id string, capacity bigint, position int, doc_id bigint, piece_no int, token_start bigint, n_tokens bigint"


@lru_cache(maxsize=4)
def encoder(path: str = TOKENIZER, pattern: str = PATTERN):
    """The tokenizer of a rank file, loaded once per worker."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str, path: str = TOKENIZER) -> np.ndarray:
    """Tokens of a whole text; lone surrogates count as replacement characters."""
    try:
        ids = encoder(path).encode_ordinary(text)
    except UnicodeEncodeError:
        ids = encoder(path).encode_ordinary(text.encode("utf-8", "replace").decode("utf-8"))
    return np.array(ids, dtype=np.int32)


def count_tokens(text: str, path: str = TOKENIZER) -> int:
    return len(token_ids(text, path))


def place(terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where an item stands in the order: min-hashes over its most repeated terms (of equal ones the rarer)."""
    rare = terms >= COMMON
    if rare.any():
        terms, counts = terms[rare], counts[rare]
    telling = terms[np.lexsort((-terms, -counts))[:TELLING]].astype(np.uint64)
    return np.sort(((telling + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33))[:HASHES].astype(np.int64)


def measured(documents: DataFrame, capacity: int, tokenizer: str = TOKENIZER) -> DataFrame:
    """``doc_id, n_tokens, terms, counts, place, others`` of every document with a text.

    ``terms`` and ``counts`` are the distinct tokens of what goes into a shared container (all of a text below the capacity, else what
    is left after its full pieces), ``others`` those that only its full pieces have.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [token_ids(t, tokenizer) for t in batch["text"]]
            rest = [np.unique(i[len(i) // capacity * capacity :], return_counts=True) for i in ids]
            others = [np.setdiff1d(i, r[0]) if len(i) >= capacity else i[:0] for i, r in zip(ids, rest, strict=True)]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [len(i) for i in ids], "terms": [r[0] for r in rest], "counts": [r[1].astype(np.int32) for r in rest], "place": [place(*r) for r in rest], "others": others})

    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInPandas(run, "doc_id bigint, n_tokens bigint, terms array<int>, counts array<int>, place array<bigint>, others array<int>")


def document_frequencies(sizes: DataFrame) -> tuple[np.ndarray, int, int]:
    """Documents per term over all documents, their number, and their tokens; at most one row per vocabulary entry reaches the driver."""
    counts = sizes.select(F.explode(F.concat("terms", "others")).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).toPandas()
    out = np.zeros(max(TERMS, int(counts["t"].max()) + 1 if len(counts) else 0))
    out[counts["t"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy(dtype=float)
    n, total = sizes.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    return out, n or 0, total or 0


class Statistics:
    """Inverse document frequencies and mean length over all documents."""

    def __init__(self, frequencies: np.ndarray, n: int, total: int):
        self.frequencies = frequencies
        self.idf = np.log1p((n - frequencies + 0.5) / (frequencies + 0.5))
        self.mean = max(1.0, total / n) if n else 1.0

    def weights(self, terms: np.ndarray, counts: np.ndarray, length: np.ndarray | float) -> np.ndarray:
        """BM25 weights of terms in an item of a length."""
        return self.idf[terms] * counts * (K1 + 1) / (counts + K1 * (1 - B + B * length / self.mean))


def rests(sizes: DataFrame, capacity: int) -> DataFrame:
    """Items to be combined: texts below the capacity, and what is left of longer ones after their full pieces."""
    full = F.floor(F.col("n_tokens") / capacity)
    rows = sizes.select("doc_id", full.cast("int").alias("piece_no"), (full * capacity).cast("bigint").alias("token_start"), (F.col("n_tokens") - full * capacity).cast("bigint").alias("n_tokens"), "terms", "counts", "place", F.monotonically_increasing_id().alias("row_no"))
    return rows.where((F.col("n_tokens") > 0) | (F.col("piece_no") == 0))


def full_pieces(sizes: DataFrame, capacity: int) -> DataFrame:
    """Pieces of exactly the capacity, each in a container of its own."""
    cut = sizes.where(F.col("n_tokens") >= capacity).select("doc_id", F.explode(F.sequence(F.lit(0), (F.floor(F.col("n_tokens") / capacity) - 1).cast("int"))).alias("piece_no"))
    name = F.concat_ws("-", F.lit("full"), F.col("doc_id").cast("string"), F.col("piece_no").cast("string"))
    return cut.select(name.alias("container_id"), F.lit(capacity).cast("bigint").alias("capacity"), F.lit(0).alias("position"), "doc_id", "piece_no", (F.col("piece_no").cast("bigint") * capacity).alias("token_start"), F.lit(capacity).cast("bigint").alias("n_tokens"))


class Index:
    """BM25 inverted index of a shard's items."""

    def __init__(self, sizes: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], statistics: Statistics):
        self.n = len(sizes)
        many = np.array([len(t) for t in terms], dtype=np.int64)
        flat = np.concatenate(terms).astype(np.int64) if self.n else np.zeros(0, dtype=np.int64)
        owner = np.repeat(np.arange(self.n), many)
        weight = statistics.weights(flat, np.concatenate(counts) if self.n else flat, sizes[owner]) if self.n else np.zeros(0)
        distinct, self.local = np.unique(flat, return_inverse=True)
        order = np.argsort(self.local, kind="stable")
        self.bounds = np.searchsorted(self.local[order], np.arange(len(distinct) + 1))
        self.posted, self.weight = owner[order], weight[order]
        self.starts = np.concatenate([[0], np.cumsum(many)])

    def scores(self, item: int) -> np.ndarray:
        """BM25 of all items of the shard for the terms of one of them as a query."""
        own = self.local[self.starts[item] : self.starts[item + 1]]
        low, many = self.bounds[own], self.bounds[own + 1] - self.bounds[own]
        at = np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())
        return np.bincount(self.posted[at], weights=self.weight[at], minlength=self.n)


def fill(sizes: np.ndarray, terms: list[np.ndarray], counts: list[np.ndarray], statistics: Statistics, capacity: int) -> list[list[int]]:
    """Containers of item positions; see the head of the module."""
    n = len(sizes)
    index = Index(sizes, terms, counts, statistics)
    unused = sizes > 0
    by_size = np.argsort(-sizes, kind="stable")
    size_order = by_size[sizes[by_size] > 0]
    least = int(sizes[size_order[-1]]) if len(size_order) else 0
    out: list[list[int]] = []
    cursor = 0
    while True:
        while cursor < len(size_order) and not unused[size_order[cursor]]:
            cursor += 1
        if cursor == len(size_order):
            break
        seed = int(size_order[cursor])
        unused[seed] = False
        taken, room = [seed], capacity - int(sizes[seed])
        if room >= least:
            score = index.scores(seed)
            ranked = np.flatnonzero((score > 0) & unused & (sizes <= room))
            ranked = ranked[np.argsort(-score[ranked], kind="stable")]
            at = 0
            while room > SMALL * capacity:
                while at < len(ranked) and sizes[ranked[at]] > room:
                    at += 1
                if at == len(ranked):
                    break
                taken.append(int(ranked[at]))
                room -= int(sizes[ranked[at]])
                at += 1
            unused[taken] = False
            ranked = ranked[unused[ranked]]
            while room >= least:
                ranked = ranked[sizes[ranked] <= room]
                if len(ranked):
                    near = ranked[:CHOICE]
                    pick = int(near[np.argmax(sizes[near])])
                    ranked = ranked[ranked != pick]
                else:
                    rest = size_order[cursor:]
                    fits = rest[unused[rest] & (sizes[rest] <= room)]
                    if not len(fits):
                        break
                    pick = int(fits[0])
                unused[pick] = False
                taken.append(pick)
                room -= int(sizes[pick])
        out.append(taken)
    empty = np.flatnonzero(sizes == 0).tolist()
    if empty:
        out[0].extend(empty) if out else out.append(empty)
    assert sum(map(len, out)) == n
    return out


def _round(items: DataFrame, shards: int, statistics: object, capacity: int, full: float, name: str) -> DataFrame:
    """Items with ``container_id``, ``position`` and ``used`` after one round of packing in shards.

    The order of places is cut into ``shards`` ranges; id and row number stand last in it, so that not even one document repeated without end
    makes a large shard. A repeated task packs the same rows in the same order.
    """

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        parts = [b for b in batches if len(b)]
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True).sort_values(["doc_id", "piece_no", "row_no"], ignore_index=True)
        sizes = pdf["n_tokens"].to_numpy(dtype=np.int64)
        boxes = fill(sizes, [np.asarray(t, dtype=np.int32) for t in pdf["terms"]], [np.asarray(c, dtype=np.int32) for c in pdf["counts"]], statistics.value, capacity)
        at = np.array([i for box in boxes for i in box], dtype=np.int64)
        out = pdf.iloc[at].copy()
        out["container_id"] = [f"{name}-{shard:06d}-{k:05d}" for k, box in enumerate(boxes) for _ in box]
        out["position"] = [p for box in boxes for p in range(len(box))]
        out["used"] = [int(sizes[box].sum()) for box in boxes for _ in box]
        # only items that are packed again still need their terms
        for c in ("terms", "counts"):
            out[c] = [t if u < full * capacity else [] for t, u in zip(out[c], out["used"], strict=True)]
        yield out

    return items.repartitionByRange(shards, "place", "doc_id", "row_no").mapInPandas(pack, f"{_ITEM}, row_no bigint, container_id string, position int, used bigint")


def packed(documents: DataFrame, capacity: int, tokenizer: str = TOKENIZER, full: float = 0.985) -> DataFrame:
    """``container_id, capacity, position, doc_id, piece_no, token_start, n_tokens``: where every text went.

    Every document with a text is in exactly one container, or, if it exceeds the capacity, in full pieces and a
    rest; null texts are none and empty texts take no room. Equal sizes are taken in order of id. Containers
    filled to less than ``full`` give their items to a second round, so at most one per shard of that round is
    far from full. A repeated document id is packed as often as it occurs. An empty table gives no rows.
    """
    sizes = checkpointed(measured(documents, capacity, tokenizer))
    frequencies, n, total = document_frequencies(sizes)
    statistics = sizes.sparkSession.sparkContext.broadcast(Statistics(frequencies, n, total))
    shards = max(1, -(-total // (capacity * CONTAINERS_PER_SHARD)), -(-n // ITEMS_PER_SHARD))
    first = checkpointed(_round(rests(sizes, capacity), shards, statistics, capacity, full, "a"))
    again = first.where(F.col("used") < full * capacity).drop("container_id", "position", "used")
    second = _round(again, max(1, shards // 16, -(-again.count() // ITEMS_PER_SHARD)), statistics, capacity, full, "b")
    columns = [c.split()[0] for c in _PLACED.split(", ")]
    rows = first.where(F.col("used") >= full * capacity).unionByName(second).withColumn("capacity", F.lit(capacity).cast("bigint"))
    return rows.select(*columns).unionByName(full_pieces(sizes, capacity).select(*columns))


def fill_report(containers: DataFrame) -> DataFrame:
    """One row: containers, items, tokens, and the share of the capacity in use."""
    per = containers.groupBy("container_id").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("items"), F.first("capacity").alias("capacity"))
    return per.agg(F.count(F.lit(1)).alias("n_containers"), F.sum("items").alias("n_items"), F.sum("used").alias("n_tokens"), (F.sum("used") / F.sum("capacity")).alias("share_used"))
