"""Problem 8: evaluation texts leaking into training text.

The held-out items make BM25 indexes over terms of three words, each with the largest weight of a term (in all items and in each block of
items). Every passage of every training text is a query, answered by block-max WAND: a passage whose summed term maxima stay under the least
threshold has no pivot and ends there; otherwise the cursors of its terms move to the pivot item, blocks whose maxima cannot reach their threshold are
skipped, and all items at or above their threshold are retrieved (no best-k). An item's threshold is the least score that
eight consecutive words of it can give, and any stretch of eight words lies whole in some passage, so no true case falls below it.
What is retrieved is verified: the words of the item's passage that the text holds in stretches of eight or more, in the passage's order, and how
much of its question and answer the text holds too. Indexes of bounded size are built on the executors; the texts are read once however many there are.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.words import words

STRETCH = 8
#: Words in a term of the index.
TERM = 3
BLOCK = 16
#: Items per index; a larger held-out set makes several indexes, which every batch of texts passes through.
ITEMS_PER_INDEX = 4_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROWS = 1 << 16


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE)
    out[0] = 1
    return np.cumprod(out)


def _grams(ids: np.ndarray) -> np.ndarray:
    """Hash of each run of STRETCH word ids."""
    n = len(ids) - STRETCH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    powers = _powers(STRETCH)
    return reduce(np.add, (mixed[k : k + n] * powers[k] for k in range(STRETCH)))


def _postings(term: np.ndarray, value: np.ndarray, weight: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds per term, values and weights, sorted by term."""
    order = np.lexsort((value, term))
    return np.searchsorted(term[order], np.arange(terms + 1)), value[order], weight[order]


class ItemIndex:
    """BM25 index over the three-word terms of a bounded set of items, with block maxima."""

    def __init__(self, items: list[tuple[int, str, str | None, str | None]], k1: float = 1.2, b: float = 0.75):
        rows = [(words(p or ""), item, words(q or ""), words(a or "")) for item, p, q, a in items]
        rows = sorted((r for r in rows if len(r[0]) >= STRETCH), key=lambda r: (len(r[0]), r[1]))
        self.items = np.array([r[1] for r in rows], dtype=np.int64)
        self.questions, self.answers = [r[2] for r in rows], [r[3] for r in rows]
        self.vocabulary = {w: i + 1 for i, w in enumerate(sorted({w for r in rows for w in r[0]}))}
        self.base = len(self.vocabulary) + 1
        self.ids = [np.array([self.vocabulary[w] for w in r[0]], dtype=np.int64) for r in rows]
        n = len(rows)
        self.blocks = -(-n // BLOCK)
        keyed = [self._keys(ids) for ids in self.ids]
        self.terms, frequency = np.unique(np.concatenate([np.unique(k) for k in keyed]) if n else np.zeros(0, dtype=np.int64), return_counts=True)
        idf = np.log1p((n - frequency + 0.5) / (frequency + 0.5))
        mean = np.mean([len(k) for k in keyed]) if n else 1.0
        term, item, weight = [], [], []
        self.thresholds = np.zeros(n)
        for i, keys in enumerate(keyed):
            at, tf = np.unique(np.searchsorted(self.terms, keys), return_counts=True)
            w = idf[at] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(keys) / mean))
            own = dict(zip(self.terms[at].tolist(), w.tolist(), strict=True))
            span = STRETCH - TERM + 1
            self.thresholds[i] = 0.9999 * min(sum(own[k] for k in set(keys[j : j + span].tolist())) for j in range(len(keys) - span + 1))
            term.append(at), item.append(np.full(len(at), i)), weight.append(w)
        self.postings = _postings(np.concatenate(term), np.concatenate(item), np.concatenate(weight), len(self.terms)) if n else None
        self.maxima = self._block_maxima() if n else None
        self.largest = np.maximum.reduceat(self.postings[2], self.postings[0][:-1]) if n else np.zeros(0)
        self.least = np.array([self.thresholds[k * BLOCK : (k + 1) * BLOCK].min() for k in range(self.blocks)])
        self.lowest = float(self.least.min()) if n else np.inf
        self.grams = [_grams(ids) for ids in self.ids]

    def _keys(self, ids: np.ndarray) -> np.ndarray:
        """One number per term; -1 where a word is in no item."""
        n = len(ids) - TERM + 1
        out = np.zeros(max(0, n), dtype=np.int64)
        for k in range(TERM):
            out = out * self.base + ids[k : k + n]
        known = np.logical_and.reduce([ids[k : k + n] > 0 for k in range(TERM)]) if n > 0 else np.zeros(0, dtype=bool)
        return np.where(known, out, -1)

    def _block_maxima(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts, item, weight = self.postings
        term = np.repeat(np.arange(len(self.terms)), np.diff(starts))
        key, where = np.unique(term * self.blocks + item // BLOCK, return_inverse=True)
        most = np.zeros(len(key))
        np.maximum.at(most, where, weight)
        return _postings(key // self.blocks, key % self.blocks, most, len(self.terms))

    def candidates(self, ids: np.ndarray, starts: np.ndarray) -> list[tuple[int, int]]:
        """``(text, item)`` positions whose score reaches the item's threshold in some passage.

        ``ids`` are the word ids of all texts (0 for a word of no item), each padded with zeros to a
        multiple of STRETCH; ``starts`` their bounds. A passage is two neighbouring runs of STRETCH words,
        so every stretch, with all its terms, lies in one. Zeros and the padding keep texts apart.
        """
        if not self.blocks or len(ids) < STRETCH:
            return []
        keys = self._keys(ids)
        at = np.flatnonzero(keys >= 0)
        term = np.searchsorted(self.terms, keys[at])
        term = np.minimum(term, len(self.terms) - 1)
        hit = self.terms[term] == keys[at]
        at, term = at[hit], term[hit]
        run = at // STRETCH
        first = np.isin(run, starts[:-1] // STRETCH)
        passage = np.concatenate([run, run[~first] - 1])
        term = np.concatenate([term, term[~first]])
        pair = np.unique(passage * len(self.terms) + term)
        passage, term = pair // len(self.terms), pair % len(self.terms)
        order = np.argsort(passage, kind="stable")
        passage, term = passage[order], term[order]
        which, begin = np.unique(passage, return_index=True)
        if not len(which):
            return []
        reachable = np.add.reduceat(self.largest[term], begin) >= self.lowest
        end = np.append(begin[1:], len(term))
        found = set()
        memory: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(reachable):
            terms = term[begin[k] : end[k]]
            asked = terms.tobytes()
            if asked not in memory:
                memory[asked] = self.wand(terms)
            if memory[asked]:
                text = int(np.searchsorted(starts // STRETCH, which[k], side="right")) - 1
                found.update((text, item) for item in memory[asked])
        return sorted(found)

    def wand(self, terms: np.ndarray) -> list[int]:
        """Items whose score for distinct ``terms`` reaches their threshold, by block-max WAND."""
        bounds, items, weights = self.postings
        block_bounds, blocks, block_most = self.maxima
        cursors = [[int(items[bounds[t]]), int(bounds[t]), int(bounds[t + 1]), float(self.largest[t]), int(t)] for t in terms]
        out = []

        def seek(cursor: list, item: int) -> None:
            _, at, end, _, _ = cursor
            at += int(np.searchsorted(items[at:end], item))
            cursor[0], cursor[1] = (int(items[at]) if at < end else -1), at

        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                bound += c[3]
                if bound >= self.lowest:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            block = item // BLOCK
            most = 0.0
            for c in cursors[: pivot + 1]:
                low, high = block_bounds[c[4]], block_bounds[c[4] + 1]
                at = low + int(np.searchsorted(blocks[low:high], block))
                most += float(block_most[at]) if at < high and blocks[at] == block else 0.0
            if most < self.least[block]:
                # no item of the block up to the next cursor can reach its threshold
                to = (block + 1) * BLOCK
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                for c in cursors[: pivot + 1]:
                    seek(c, max(to, item + 1))
            elif cursors[0][0] == item:
                score = sum(float(weights[c[1]]) for c in cursors[: pivot + 1])
                if score >= self.thresholds[item]:
                    out.append(item)
                for c in cursors[: pivot + 1]:
                    seek(c, item + 1)
            else:
                for c in cursors[:pivot]:
                    if c[0] < item:
                        seek(c, item)
            cursors = [c for c in cursors if c[0] >= 0]
        return out

    def shared(self, ids: np.ndarray, item: int, grams: np.ndarray | None = None) -> int:
        """Words of an item that stand in the text in stretches of STRETCH or more, in the item's order."""
        own, theirs = self.grams[item], _grams(ids) if grams is None else grams
        at = np.flatnonzero(np.isin(theirs, own))
        if not len(at):
            return 0
        order = np.argsort(own, kind="stable")
        low, high = np.searchsorted(own[order], theirs[at]), np.searchsorted(own[order], theirs[at], side="right")
        where = {}
        for j, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
            for i in order[a:b].tolist():
                where.setdefault(j - i, []).append(i)
        stretches = []
        for shift, runs in where.items():
            runs.sort()
            first = last = runs[0]
            for i in runs[1:]:
                if i != last + 1:
                    stretches.append((first + shift, first, last + STRETCH))
                    first = i
                last = i
            stretches.append((first + shift, first, last + STRETCH))
        return _in_order(stretches, len(self.ids[item]))


def _in_order(stretches: list[tuple[int, int, int]], words_of_item: int) -> int:
    """Most words of an item that stretches ``(place in the text, from, to)`` cover one after the other in both; what two of them share of the item counts once."""
    best = np.zeros(words_of_item + 1, dtype=np.int64)  # by the item's last covered word, among stretches that have ended in the text
    ended: list[tuple[int, int, int]] = []
    for start, low, high in sorted(stretches):
        while ended and ended[0][0] <= start:
            _, to, n = heapq.heappop(ended)
            np.maximum(best[to:], n, out=best[to:])
        gain = np.minimum(high - low, high - np.arange(high))
        heapq.heappush(ended, (start + high - low, high, int((best[:high] + gain).max())))
    return max([int(best[-1]), *(n for _, _, n in ended)])


def overlap(text: set[str], part: list[str]) -> float | None:
    """Share of the distinct words of a question or answer that a text holds; null where it has no words."""
    return len(text.intersection(part)) / len(set(part)) if part else None


_FOUND = "doc_id bigint, item_id bigint, n_shared int, n_words int, question_overlap double, answer_overlap double"


def _search(indexes: list, share: float):
    """``indexes``: broadcast pickles of ItemIndex, or indexes themselves."""
    opened: list[ItemIndex] = []

    def open_all() -> Iterator[ItemIndex]:
        if len(indexes) > 1:  # several are opened one after the other, so a worker holds one at a time
            yield from (i if isinstance(i, ItemIndex) else pickle.loads(i.value) for i in indexes)
            return
        if not opened:
            opened.extend(i if isinstance(i, ItemIndex) else pickle.loads(i.value) for i in indexes)
        yield from opened

    def look(index: ItemIndex, group: list[tuple[int, list[str]]]) -> list[tuple]:
        get = index.vocabulary.get
        coded = []
        for _, tokens in group:
            ids = np.zeros((len(tokens) // STRETCH + 1) * STRETCH, dtype=np.int64)
            ids[: len(tokens)] = [get(t, 0) for t in tokens]
            coded.append(ids)
        starts = np.cumsum([0, *map(len, coded)])
        out, grams, at, held = [], None, -1, set()
        for text, item in index.candidates(np.concatenate(coded), starts):
            doc, tokens = group[text]
            if text != at:
                grams, at, held = _grams(coded[text]), text, set(tokens)
            n, total = index.shared(coded[text], item, grams), len(index.ids[item])
            if n and n >= share * total:
                out.append((doc, int(index.items[item]), n, total, overlap(held, index.questions[item]), overlap(held, index.answers[item])))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups, size = [[]], 0
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                tokens = words(text)
                if len(tokens) < STRETCH:
                    continue
                groups[-1].append((doc, tokens))
                size += len(tokens)
                if size >= _ROWS:
                    groups.append([])
                    size = 0
            rows = [r for index in open_all() for group in groups if group for r in look(index, group)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])

    return run


def item_indexes(items: DataFrame) -> DataFrame:
    """``shard, index``: pickled indexes of at most some ITEMS_PER_INDEX items each, built where the items are."""
    rows = items.where("item_id is not null and passage is not null").select(F.col("item_id").cast("bigint"), "passage", "question", "answer").distinct()
    shards = max(1, -(-rows.count() // ITEMS_PER_INDEX))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["item_id", "passage"])
        index = ItemIndex(list(ordered[["item_id", "passage", "question", "answer"]].itertuples(index=False, name=None)))
        return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "index": [pickle.dumps(index)]})

    return rows.withColumn("shard", F.pmod(F.xxhash64("item_id", "passage"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(build, "shard int, index binary")


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.25) -> DataFrame:
    """``doc_id, item_id, n_shared, n_words, question_overlap, answer_overlap``: documents that hold at least ``share`` of an item's passage.

    Words are compared without letter case, punctuation, markup, escapes, invisible or disguised characters; only
    stretches of eight or more consecutive words of the passage count, and only as far as they follow each other in the passage's order. The overlaps
    are the shares of the question's and the answer's words that the document holds; sharing these alone is no leak. Null and empty texts or passages, and
    passages of under eight words, give no rows. Repeated items count once; a repeated document id gives its best share.
    Whole texts are read, however long, and once. The driver hands on one index at a time and reads none.
    """
    context = documents.sparkSession.sparkContext
    indexes = [context.broadcast(bytes(r["index"])) for r in item_indexes(items).toLocalIterator()]
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = texts.mapInPandas(_search(indexes, share), _FOUND)
    columns = [c.split()[0] for c in _FOUND.split(", ")][2:]
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct(*columns)).alias("b"))
    return best.select("doc_id", "item_id", "b.*")


def leaked_items(found: DataFrame) -> DataFrame:
    """Per item: documents that leak it, those that hold its whole question and its whole answer, and the largest share."""
    return found.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.count_if(F.col("question_overlap") == 1).alias("n_with_question"),
        F.count_if(F.col("answer_overlap") == 1).alias("n_with_answer"),
        F.max(F.col("n_shared") / F.col("n_words")).alias("largest_share"),
    )
