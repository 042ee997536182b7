import random

import numpy as np
import pytest

from graphloom.llm.leaks import STRETCH, ItemIndex, _in_order, leaked_items, leaks
from graphloom.llm.words import words
from tests.conftest import tuples

DOCS = "doc_id bigint, text string, item_id string, n_shared int"
ITEMS = "item_id bigint, passage string, question string, answer string, doc_id int"
VOCABULARY = [a + b for a in ("ba", "co", "du", "fe", "gi", "ho") for b in ("ker", "lum", "net", "pod", "rix", "sal", "tor", "vim")]
PASSAGE = "The reviewer found that nine callers of the ledger gate fail once the second worker is stopped, so choose between a rollback and a patch in the shared queue module today."


def covered_in_order(t, p):
    """Brute force over the grid: most words of ``p`` in stretches of eight or more that ``t`` holds in the same order."""
    run = [[0] * (len(t) + 1) for _ in range(len(p) + 1)]
    best = [[0] * (len(t) + 1) for _ in range(len(p) + 1)]
    for i in range(1, len(p) + 1):
        for j in range(1, len(t) + 1):
            run[i][j] = run[i - 1][j - 1] + 1 if p[i - 1] == t[j - 1] else 0
            best[i][j] = max(best[i - 1][j], best[i][j - 1], *(best[i - k][j - k] + k for k in range(STRETCH, run[i][j] + 1)))
    return best[-1][-1]


def share(text, passage):
    t, p = words(text or ""), words(passage or "")
    return covered_in_order(t, p) / len(p) if len(p) >= STRETCH else 0.0


def test_random_texts_equal_brute_force(frame):
    draw = random.Random(11)
    sentence = lambda n: " ".join(draw.choice(VOCABULARY) for _ in range(n))
    items = [(i, sentence(draw.randrange(8, 60)), "q", "a", 1) for i in range(60)]
    docs = []
    for d in range(150):
        parts = [sentence(draw.randrange(0, 60))]
        for _ in range(draw.randrange(3)):
            source = draw.choice(items)[1].split()
            low = draw.randrange(len(source))
            parts += [" ".join(source[low : low + draw.randrange(4, 40)]), sentence(draw.randrange(12))]
        docs.append((d, " ".join(parts), "x", 0))
    expected = sorted(((d, i) for d, t, _, _ in docs for i, p, _, _, _ in items if share(t, p) >= 0.25), key=repr)
    assert expected and tuples(leaks(frame(DOCS, *docs), frame(ITEMS, *items)), "doc_id", "item_id") == expected


@pytest.mark.parametrize(
    "change",
    [
        str.upper,
        lambda t: t.replace(" ", "\r\n"),
        lambda t: t.replace(" ", " <br/> "),
        lambda t: t.replace(" ", "&nbsp;"),
        lambda t: t.replace("second", "<b>sec</b>ond"),
        lambda t: t.replace("e", "е").replace("o", "о"),
        lambda t: "​".join(t),
        lambda t: t.replace("n", "\xadn"),
        lambda t: "".join(chr(ord(c) + 0xFEE0) if c.isalpha() else c for c in t),
        lambda t: t.replace(" ", " *"),
        lambda t: t.replace("a", "á"),
        lambda t: "> " + t.replace(",", "\n> "),
        lambda t: t.replace("a", "\\u0061"),
        lambda t: "<!-- x -->" + t + "<!-- y",
    ],
)
def test_disguises(frame, change):
    df = leaks(frame(DOCS, (1, "Intro. " + change(PASSAGE) + " End.", "x", 0)), frame(ITEMS, (7, PASSAGE, None, None, 1)))
    assert tuples(df, "doc_id", "item_id") == [(1, 7)]


def test_limits(frame):
    tokens = PASSAGE.split()
    n = len(words(PASSAGE))
    docs = [
        (1, " ".join(tokens[:8]), "x", 0),
        (2, " ".join(tokens[: -(-n // 4)]), "x", 0),
        (3, " ".join(tokens[:7]) + " other " + " ".join(tokens[8:15]), "x", 0),
        (4, " ".join(sorted(tokens)), "x", 0),
        (5, " ".join(tokens[10:18]) + " gap " + " ".join(tokens[18:26]), "x", 0),
    ]
    assert n >= 29 and tuples(leaks(frame(DOCS, *docs), frame(ITEMS, (7, PASSAGE, "", "", 1))), "doc_id", "n_shared") == sorted([(5, 16)] + [(2, -(-n // 4))] * (-(-n // 4) >= 8) + [(1, 8)] * (8 >= n / 4), key=repr)


def test_nulls_empty_repeats(frame):
    docs = [(1, None, "", 0), (2, "", "", 0), (3, "short", "", 0), (None, PASSAGE, "", 0), (4, PASSAGE, "", 0), (4, PASSAGE, "", 0), (5, "x" * 200_000 + " " + PASSAGE, "", 0)]
    items = [(7, PASSAGE, "Where is it?", "shared queue", 1), (7, PASSAGE, "Where is it?", "shared queue", 1), (8, None, "", "", 1), (9, "", "", "", 1), (10, "too short to count", "", "", 1), (None, PASSAGE, "", "", 1)]
    df = leaks(frame(DOCS, *docs), frame(ITEMS, *items))
    assert tuples(df, "doc_id", "item_id", "answer_overlap") == [(4, 7, 1.0), (5, 7, 1.0)]
    assert tuples(leaked_items(df)) == [(7, 2, 0, 2, 1.0)]
    assert tuples(leaks(frame(DOCS), frame(ITEMS, *items))) == tuples(leaks(frame(DOCS, *docs), frame(ITEMS))) == []


def test_order_counts(frame):
    tokens = words(PASSAGE)
    late_first = " ".join([*tokens[20:28], "and", *tokens[:8]])
    df = leaks(frame(DOCS, (1, late_first, "", 0), (2, " ".join([*tokens[:8], "and", *tokens[20:28]]), "", 0)), frame(ITEMS, (7, PASSAGE, "", "", 1)), share=0.5)
    assert tuples(df, "doc_id", "n_shared") == [(2, 16)]
    assert _in_order([(0, 10, 18), (9, 0, 8), (20, 12, 22)], 30) == 18 and _in_order([], 9) == 0
    assert _in_order([(k * 10, 0, 10) for k in range(1000)], 10) == 10


def test_several_indexes(frame, monkeypatch):
    from graphloom.llm import leaks as module

    monkeypatch.setattr(module, "ITEMS_PER_INDEX", 2)
    items = [(i, f"{PASSAGE} case {'x' * i}", "", "", 1) for i in range(7)]
    df = leaks(frame(DOCS, (1, PASSAGE, "", 0), (2, "nothing of it", "", 0)), frame(ITEMS, *items))
    assert tuples(df, "doc_id", "item_id") == [(1, i) for i in range(7)]


def test_wand_equals_full_scores():
    draw = random.Random(8)
    index = ItemIndex([(i, " ".join(draw.choice(VOCABULARY[:9]) for _ in range(draw.randrange(8, 40))), "", "") for i in range(120)])
    bounds, items, weights = index.postings
    for _ in range(200):
        terms = np.array(sorted(draw.sample(range(len(index.terms)), draw.randrange(1, 14))))
        score = np.zeros(len(index.items))
        for t in terms:
            np.add.at(score, items[bounds[t] : bounds[t + 1]], weights[bounds[t] : bounds[t + 1]])
        assert index.wand(terms) == np.flatnonzero((score >= index.thresholds) & (score > 0)).tolist()


def test_thresholds_never_miss():
    draw = random.Random(2)
    items = [(i, " ".join(draw.choice(VOCABULARY[:20]) for _ in range(40)), "", "") for i in range(40)]
    index = ItemIndex(items)
    for position, item in enumerate(index.items):
        passage = words(items[item][1])
        for low in range(len(passage) - STRETCH + 1):
            for pad in (0, 3, 7):
                text = ["zzz"] * pad + passage[low : low + STRETCH]
                ids = np.zeros((len(text) // STRETCH + 1) * STRETCH, dtype=np.int64)
                ids[: len(text)] = [index.vocabulary.get(w, 0) for w in text]
                assert (0, position) in index.candidates(ids, np.array([0, len(ids)]))
