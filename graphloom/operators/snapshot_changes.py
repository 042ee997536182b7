"""Problem 6: what changed between consecutive full snapshots.

The snapshots of one branch are a stream. All their rows are range-partitioned by (stream, name) and
sorted once, so every snapshot lies in key order and the same stretch of keys of all snapshots of a stream lies
in one place. The order is cut into content-defined chunks: a new chunk begins at a key whose hash
meets a mask (one key in ``mean_rows``), or after ``max_rows`` keys without such a one. Keys alone decide, so a symbol
that comes or goes moves at most its own chunk's borders. The digest of a snapshot's chunk is the number of its rows
with a sum and an xor of their hashes, repeated rows counted once. Chunks of consecutive snapshots with
equal digests are discarded; only the rows of the others are joined by name and classified. The range
partitioning is the only exchange of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.functions.text import some
from graphloom.session import bounded_broadcast

#: Columns of a row as it is compared: two hashes of what always counts, two of the source hash where there is one.
CONTENT = ["c1", "c2", "h1", "h2"]
MEAN_ROWS = 4
MAX_ROWS = 32
_CHANGE = "stream string, ord int, qualified_name string, change string"
_STATS = "stream string, n_chunks bigint, n_matched bigint, n_rows bigint, n_discarded bigint"


def streams(snapshots: DataFrame) -> DataFrame:
    """``snapshot_id, stream, ord, last``: the READY snapshots of each repository and branch, numbered from 1 by time.

    Order is by ``created_at``, then id; repeated rows count once; snapshots without a time are
    left out. ``stream`` is the id of the first of them. The window runs over the narrow snapshot list, not over its symbols.
    """
    ready = (
        snapshots.where((F.upper(F.trim(F.element_at("snapshot_metadata", "status"))) == "READY") & F.col("created_at").isNotNull() & F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.min("repository_id").alias("repository_id"), F.min("branch_name").alias("branch_name"), F.min("created_at").alias("created_at"))
    )
    order = W.partitionBy("repository_id", "branch_name").orderBy("created_at", "id")
    return ready.select(F.col("id").alias("snapshot_id"), F.first("id").over(order).alias("stream"), F.row_number().over(order).alias("ord"), F.lead("id").over(order).isNull().alias("last"))


def snapshot_pairs(snapshots: DataFrame) -> DataFrame:
    """``snapshot_id, previous_id``: every READY snapshot but the first of its repository and branch."""
    known = streams(snapshots)
    before = known.select("stream", (F.col("ord") + 1).alias("ord"), F.col("snapshot_id").alias("previous_id"))
    return known.join(before, ["stream", "ord"]).select("snapshot_id", "previous_id")


def comparable(artifacts: DataFrame) -> DataFrame:
    """Rows as they are compared: ``sid, name`` and CONTENT, 128 bits each for the fixed part and the source hash.

    Nulls are hashed as a character of their own, so that a value never moves from one column to the next unseen.
    """
    known = lambda c: F.coalesce(c.cast("string"), F.lit("\x00"))
    fixed = [known(F.col("artifact_type")), F.coalesce("signature", F.lit("")), known(F.translate("location", "\\", "/")), known(F.col("line_end"))]
    digest = some("source_hash")
    rows = artifacts.select(F.col("snapshot_id").alias("sid"), some("qualified_name").alias("name"), F.xxhash64(*fixed).alias("c1"), F.xxhash64(F.lit(1), *fixed).alias("c2"), F.when(digest.isNotNull(), F.xxhash64(digest)).alias("h1"), F.when(digest.isNotNull(), F.xxhash64(F.lit(1), digest)).alias("h2"))
    return rows.where("sid is not null and name is not null")


def key_sorted(snapshots: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Every snapshot in key order: ``stream, name, ord, last, key_hash`` and CONTENT, nulls of the source hash as 0 with ``hashed`` false."""
    known = bounded_broadcast(streams(snapshots)).withColumnRenamed("snapshot_id", "sid")
    rows = comparable(artifacts).join(known, "sid").select("stream", "name", "ord", "last", F.xxhash64("name").alias("key_hash"), "c1", "c2", F.col("h1").isNotNull().alias("hashed"), F.coalesce("h1", F.lit(0)).alias("h1"), F.coalesce("h2", F.lit(0)).alias("h2"))
    return rows.repartitionByRange("stream", "name").sortWithinPartitions("stream", "name", "ord", "c1", "c2", "hashed", "h1", "h2")


def _mixed(*columns: np.ndarray) -> np.ndarray:
    """One 64-bit hash per row."""
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        out = (out ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


class _Block:
    """Whole chunks of sorted rows, one row per snapshot and name."""

    def __init__(self, rows: pd.DataFrame, mean_rows: int, max_rows: int):
        stream, name, order = (rows[c].to_numpy() for c in ("stream", "name", "ord"))
        differs = lambda x: np.concatenate([[True], x[1:] != x[:-1]])
        new_stream = differs(stream)
        new_key = new_stream | differs(name)
        kept = new_key | differs(order)  # repeats of a name in a snapshot: the smallest content stands for all
        self.key = (np.cumsum(new_key) - 1)[kept]
        first = np.flatnonzero(new_key)
        cut = new_stream[first] | (rows["key_hash"].to_numpy()[first].astype(np.uint64) % np.uint64(mean_rows) == 0)
        at = np.arange(len(first))
        since = at - np.maximum.accumulate(np.where(cut, at, 0))
        cut |= since % max_rows == 0
        self.chunk_of_key = np.cumsum(cut) - 1
        self.last_cut = int(np.flatnonzero(kept & new_key)[np.flatnonzero(cut)[-1]]) if len(first) else 0
        self.rows = rows[kept]
        self.name, self.stream = name[first], stream[first]

    def compared(self) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Columns, the chunk ``(chunk, ord)`` of each row, and per chunk whether it matches the one before and the one after."""
        columns = {c: self.rows[c].to_numpy() for c in ("ord", "last", "c1", "c2", "hashed", "h1", "h2")}
        chunk, order = self.chunk_of_key[self.key], columns["ord"].astype(np.int64)
        code = chunk * (np.int64(1) << 31) + order
        cells, cell = np.unique(code, return_inverse=True)
        h = _mixed(self.rows["key_hash"].to_numpy(), columns["c1"], columns["c2"], columns["hashed"], columns["h1"], columns["h2"])
        by = np.argsort(cell, kind="stable")
        starts = np.searchsorted(cell[by], np.arange(len(cells)))
        n, total, xor = np.bincount(cell, minlength=len(cells)), np.add.reduceat(h[by], starts), np.bitwise_xor.reduceat(h[by], starts)
        follows = np.zeros(len(cells), dtype=bool)  # equal to the same chunk of the snapshot before
        follows[1:] = (cells[1:] == cells[:-1] + 1) & (n[1:] == n[:-1]) & (total[1:] == total[:-1]) & (xor[1:] == xor[:-1])
        return columns, cell, follows, np.concatenate([follows[1:], [False]])

    def changes(self) -> pd.DataFrame:
        columns, cell, before, after = self.compared()
        order = columns["ord"].astype(np.int64)
        now = np.flatnonzero(~before[cell] & (order > 1))
        was = np.flatnonzero(~after[cell] & ~columns["last"].astype(bool))
        pair = np.concatenate([self.key[now] * (np.int64(1) << 31) + order[now], self.key[was] * (np.int64(1) << 31) + order[was] + 1])
        row, side = np.concatenate([now, was]), np.concatenate([np.zeros(len(now), dtype=int), np.ones(len(was), dtype=int)])
        by = np.lexsort((side, pair))
        pair, row, side = pair[by], row[by], side[by]
        paired = np.zeros(len(pair), dtype=bool)
        paired[:-1] = pair[1:] == pair[:-1]
        other = row[np.minimum(np.arange(len(pair)) + 1, len(pair) - 1)] if len(pair) else row
        differs = (columns["c1"][row] != columns["c1"][other]) | (columns["c2"][row] != columns["c2"][other])
        both = columns["hashed"][row].astype(bool) & columns["hashed"][other].astype(bool)
        differs |= both & ((columns["h1"][row] != columns["h1"][other]) | (columns["h2"][row] != columns["h2"][other]))
        second = np.concatenate([[False], paired[:-1]]) if len(pair) else paired
        kind = np.where(paired, np.where(differs, "changed", ""), np.where(side == 0, "added", "removed"))
        told = ~second & (kind != "")
        key = (pair[told] >> 31).astype(np.int64)
        return pd.DataFrame({"stream": self.stream[key], "ord": (pair[told] & ((1 << 31) - 1)).astype(np.int32), "qualified_name": self.name[key], "change": kind[told]})

    def statistics(self) -> pd.DataFrame:
        columns, cell, before, _ = self.compared()
        later = columns["ord"] > 1
        per_cell = pd.DataFrame({"cell": cell[later], "stream": self.stream[self.key[later]], "matched": before[cell[later]]})
        per_cell["first"] = ~per_cell["cell"].duplicated()
        per_cell["first_matched"] = per_cell["first"] & per_cell["matched"]
        out = per_cell.groupby("stream").agg(n_chunks=("first", "sum"), n_matched=("first_matched", "sum"), n_rows=("cell", "size"), n_discarded=("matched", "sum"))
        return out.reset_index()


def _chunked(batches: Iterator[pd.DataFrame], result: Callable[[_Block], pd.DataFrame], mean_rows: int, max_rows: int) -> Iterator[pd.DataFrame]:
    """Results of whole chunks; rows of the chunk that a batch leaves open wait for the next one."""
    open_rows: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        open_rows.append(batch)
        rows = pd.concat(open_rows, ignore_index=True) if len(open_rows) > 1 else batch
        at = _Block(rows, mean_rows, max_rows).last_cut
        if at:
            yield result(_Block(rows.iloc[:at], mean_rows, max_rows))
        # a repeated row of an open chunk is kept once, so repeats without end do not pile up
        rest = rows.iloc[at:]
        open_rows = [rest[~rest.duplicated(["stream", "name", "ord"])].reset_index(drop=True)]
    if open_rows:
        yield result(_Block(open_rows[0], mean_rows, max_rows))


def snapshot_changes(snapshots: DataFrame, artifacts: DataFrame, mean_rows: int = MEAN_ROWS, max_rows: int = MAX_ROWS) -> DataFrame:
    """``snapshot_id, qualified_name, change`` with change ``added``, ``removed`` or ``changed``.

    Names are compared without blanks around them; null or empty names are no symbols. A null
    signature is empty, either slash is the same, source hashes count only where both snapshots
    have one, nulls equal nulls elsewhere. A name held by several rows of one snapshot is
    represented by one chosen by content, so repeated rows change nothing. Empty tables give no rows.
    A chunk has ``mean_rows`` keys on average and ``max_rows`` at most; the result does not depend on either.
    """
    found = key_sorted(snapshots, artifacts).mapInPandas(partial(_chunked, result=_Block.changes, mean_rows=mean_rows, max_rows=max_rows), _CHANGE)
    names = bounded_broadcast(streams(snapshots).select("stream", "ord", "snapshot_id"))
    return found.join(names, ["stream", "ord"]).select("snapshot_id", "qualified_name", "change")


def chunk_statistics(snapshots: DataFrame, artifacts: DataFrame, mean_rows: int = MEAN_ROWS, max_rows: int = MAX_ROWS) -> DataFrame:
    """Per repository and branch: chunks of all snapshots but the first, those that match the snapshot before, their rows, and the rows discarded with them.

    Counted per place of the sort, so a chunk that a place's border cuts counts as two.
    """
    parts = key_sorted(snapshots, artifacts).mapInPandas(partial(_chunked, result=_Block.statistics, mean_rows=mean_rows, max_rows=max_rows), _STATS)
    return parts.groupBy("stream").agg(*(F.sum(c).alias(c) for c in ("n_chunks", "n_matched", "n_rows", "n_discarded")))


def change_counts(changes: DataFrame) -> DataFrame:
    """Changes per snapshot and kind."""
    return changes.groupBy("snapshot_id", "change").agg(F.count(F.lit(1)).alias("n_symbols"))
