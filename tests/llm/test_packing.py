import random
from collections import Counter, defaultdict

import numpy as np

from graphloom.llm.packing import K1, TOKENIZER, B, Index, Statistics, count_tokens, encoder, fill, fill_report, measured, packed, place, token_ids
from tests.conftest import tuples

DOCS = "doc_id bigint, text string, n_tokens string, terms int, shard int, container_id int"


def docs(frame, *rows):
    return frame(DOCS, *((d, t, "x", 1, 2, 3) for d, t in rows))


def check(df, texts, capacity):
    """Every text is packed once and whole, or in consecutive pieces if it exceeds the capacity."""
    boxes, pieces = Counter(), defaultdict(list)
    for box, room, _, doc, piece, start, n in tuples(df):
        assert room == capacity
        boxes[box] += n
        pieces[doc].append((piece, start, n))
    assert max(boxes.values(), default=0) <= capacity
    assert sorted(pieces) == sorted(d for d, t in texts if t is not None)
    for d, t in texts:
        if t is not None:
            parts, total = sorted(pieces[d]), count_tokens(t)
            assert sum(n for _, _, n in parts) == total
            assert len(parts) == max(1, -(-total // capacity))
            assert [(i * capacity) for i in range(len(parts))] == [s for _, s, _ in parts]
    return boxes


def test_counts_equal_the_tokenizer():
    text = "Grüße, world! it's 2026\n\n  done"
    assert count_tokens(text) == len(encoder(TOKENIZER).encode_ordinary(text)) and encoder(TOKENIZER).decode(encoder(TOKENIZER).encode_ordinary(text)) == text
    assert count_tokens("") == 0 and count_tokens("<|endoftext|>") > 1 and count_tokens("a\ud800b") > 0


def test_every_text_is_packed(frame):
    draw = random.Random(4)
    texts = [(i, " ".join(draw.choice(("red", "green", "blue", "query", "table")) for _ in range(draw.choice((1, 5, 20, 60, 90, 300))))) for i in range(400)]
    texts += [(1000, ""), (1001, None), (1002, " "), (1003, "word " * 5000)]
    boxes = check(packed(docs(frame, *texts), 128), texts, 128)
    total = sum(boxes.values())
    sizes = sorted((min(128, n - at) for d, t in texts if t for n in [count_tokens(t)] for at in range(0, n, 128)), reverse=True)
    rooms: list[int] = []
    for size in sizes:  # first fit by falling size
        at = next((i for i, room in enumerate(rooms) if room >= size), None)
        if at is None:
            rooms.append(128 - size)
        else:
            rooms[at] -= size
    assert len(boxes) <= 1.02 * len(rooms) + 1
    report = fill_report(packed(docs(frame, *texts), 128)).first()
    assert report.n_tokens == total and report.n_containers == len(boxes)


def test_shapes(frame):
    assert tuples(packed(docs(frame), 64)) == []
    assert tuples(packed(docs(frame, (1, None), (None, "x")), 64)) == []
    for texts in ([(1, "")], [(1, "a b"), (2, "a b")], [(1, "x " * 63 + "x")], [(1, "w " * 40), (2, "w " * 40), (3, "w " * 40)]):
        check(packed(docs(frame, *texts), 64), texts, 64)
    repeated = tuples(packed(docs(frame, (1, "a b"), (1, "a b")), 64))
    assert [(d, p, n) for _, _, _, d, p, _, n in repeated] == [(1, 0, count_tokens("a b"))] * 2


def test_measured_terms(frame):
    (row,) = measured(docs(frame, (1, "One one two one")), 64).collect()
    assert row.n_tokens == count_tokens("One one two one") and sum(row.counts) == row.n_tokens and max(row.counts) == 2 and not row.others
    (row,) = measured(docs(frame, (1, " a b b c" * 3)), 5).collect()
    assert row.n_tokens == 12 and sum(row.counts) == 2 and len(row.terms) + len(row.others) == 3


def test_scores_are_bm25():
    draw = np.random.default_rng(3)
    texts = [draw.integers(0, 30, draw.integers(1, 40)) for _ in range(50)]
    parts = [np.unique(t, return_counts=True) for t in texts]
    df = np.zeros(40)
    for t, _ in parts:
        df[t] += 1
    known = Statistics(df, 50, sum(map(len, texts)))
    sizes = np.array([len(t) for t in texts])
    got = Index(sizes, [t for t, _ in parts], [c for _, c in parts], known).scores(7)
    mean = sizes.mean()
    for i, text in enumerate(texts):
        score = 0.0
        for q in set(texts[7].tolist()):
            tf = int((text == q).sum())
            score += np.log(1 + (50 - df[q] + 0.5) / (df[q] + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(text) / mean))
        assert abs(score - got[i]) < 1e-9


def _sets(*sets):
    return [np.array(t) for t in sets], [np.ones(len(t), dtype=int) for t in sets]


def test_seed_takes_its_neighbours():
    terms, counts = _sets([1, 2, 3], [7, 8], [1, 2, 4], [7, 9], [2, 3])
    known = Statistics(np.full(50, 2.0), 50, 200)
    boxes = fill(np.array([40, 39, 20, 21, 20]), terms, counts, known, 100)
    assert sorted(boxes[0]) == [0, 2, 4] and sorted(boxes[1]) == [1, 3]


def test_no_stranger_before_the_neighbours_run_out():
    """The stranger fits best, yet a neighbour that fits comes first, in small room too."""
    terms, counts = _sets([1, 2], [1, 5], [9, 8], [2, 6])
    boxes = fill(np.array([80, 5, 10, 6]), terms, counts, Statistics(np.full(50, 2.0), 50, 200), 100)
    assert boxes[0][:3] == [0, 3, 1] and 2 not in boxes[0][:3]


def test_likely_neighbours_share_a_shard(frame):
    """Texts of twelve subjects in random order: most of an item's best neighbours lie in its range of the order."""
    draw = random.Random(5)
    word = lambda: "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7))
    vocabulary = [[word() for _ in range(12)] for _ in range(12)]
    texts = [" ".join(draw.choice(vocabulary[i % 12]) for _ in range(30)) + " and the same words for all of them" for i in range(360)]
    parts = [np.unique(token_ids(t), return_counts=True) for t in texts]
    df = np.zeros(1 << 18)
    for t, _ in parts:
        df[t] += 1
    sizes = np.array([int(c.sum()) for _, c in parts])
    known = Statistics(df, len(texts), int(sizes.sum()))
    order = sorted(range(360), key=lambda i: place(*parts[i]).tolist())
    shard = np.empty(360, dtype=int)
    shard[order] = np.arange(360) * 4 // 360
    index = Index(sizes, [t for t, _ in parts], [c for _, c in parts], known)
    ratio = []
    for i in range(0, 360, 9):
        score = index.scores(i)
        score[i] = 0
        ratio.append(np.sort(score[shard == shard[i]])[-10:].mean() / np.sort(score)[-10:].mean())
    assert np.mean(ratio) > 0.88


def test_fill_is_a_partition():
    draw = random.Random(9)
    for _ in range(50):
        n = draw.randrange(0, 60)
        sizes = np.array([draw.randrange(0, 30) for _ in range(n)], dtype=np.int64)
        terms, counts = _sets(*(sorted(draw.sample(range(40), draw.randrange(0, 9))) for _ in range(n)))
        boxes = fill(sizes, [t.astype(np.int32) for t in terms], counts, Statistics(np.ones(40), 60, 900), 30)
        assert sorted(i for b in boxes for i in b) == list(range(n)) and all(sizes[b].sum() <= 30 for b in boxes)
