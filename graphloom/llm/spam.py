"""Problem 9: keyword-stuffed and link-list pages.

A text is cut into units (lines; long lines of sentences into sentences). Each unit is reduced to a shape: what
it is made of, how many words, capitals, separators and links, and whether it is closed like a sentence. No list of words is
used. Units of one shape on a page are judged together by statistics that prose of any language shares and keyword text lacks:

* the share of short words (up to three letters), which every sentence needs to hold together, and
* how soon longer words come back, within a unit and within neighbouring units (in windows of WINDOW words).

Links with few words, and rows of tags or counted labels, are told by what they are made of; so is working text (code, logs, tables,
version and test lists), by its mixture of words with digits, paths and signs. The shapes are then grouped over the whole corpus: what
a shape mostly carries there weighs as much as PRIOR words of a page's own evidence, so few words alone decide nothing. A page is spam if
more than half of its words stand in units judged so.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import checkpointed

SHORT = 3
WINDOW = 24
PRIOR = 16
UNSEEN = 6
#: Repetition and share of short words at which text is as likely keywords as prose, and the span over which the latter tells.
REPETITION, SHORT_SHARE, SHORT_SPAN = 0.24, 0.25, 0.12
#: Words per link up to which they are its label, and the least number of links or tags that make a list.
LABEL_WORDS, LEAST_LINKS, LEAST_TAGS = 5, 3, 4
WORK, TEXT, TAGS, LINKS = range(4)
#: Shapes of one make: 8 word counts, 4 uses of capitals, 3 of separators, 3 of links, closed or not.
_MADE = 8 * 4 * 3 * 3 * 2

_ANCHOR = re.compile(r"<a\s[^<>]*?href\s*=\s*[\"']?([^\"'\s<>]+)[\"']?[^<>]*>([^<]*(?:<(?!/?a\b)[^<]*)*)</a>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_LINK = re.compile(r"\]?\(?\b(?:https?|ftp)://[^\s)>\]]+\)?|\bwww\.[^\s)>\]]+|(?<![\w.-])[a-z0-9-]++(?:\.[a-z0-9-]++)++(?<=[a-z]{2})/[^\s)>\]]*", re.I)
_SENTENCE_END = re.compile(r"(?<=[.!?;])\s+(?=[\W_]{0,6}[A-ZÀ-ÞÄÖÜ0-9])")
_NAMED = re.compile(r"[^\W_][-_.][^\W_]|\d")
_MARK = re.compile(r"(?:[#>*•·–-]+\s+|\d+[.)]\s+)+")
_WORD = re.compile(r"[^\W\d_]+")
_SIGN = re.compile(r"[\d_={}\[\]<>\\`$@]|\(\)|\w/\w|^/\w")
_TAGGED = re.compile(r"(?<!\S)(?:#[^\W\d]\w*|[^\W\d][\w-]*\(\d+\))[,;]?(?!\S)")
_SIGNS = frozenset("|-–=/•·*+&:~")
_SEPARATOR = re.compile(r"[,;|•·/]")
_GROUP = "shape int, words int, weight int, evidence double"


def units(text: str) -> Iterator[str]:
    """Units of a whole text, blank ones left out."""
    if "<" in text:
        listed = text.count("<a ") > 2
        text = _ANCHOR.sub(lambda m: f"\n[{m.group(2)}]({m.group(1)})\n" if listed else f"{m.group(2)} ({m.group(1)})", text)
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    for line in text.splitlines():
        line = line.strip()
        if not line:
            continue
        if len(line) > 60 and (". " in line or "! " in line or "? " in line):
            yield from _SENTENCE_END.split(line)
        else:
            yield line


def measured(unit: str) -> tuple[int, list[str], int, int]:
    """``shape, words, weight, links`` of a unit; the shape is one of some 3,000 numbers."""
    bare, links = _LINK.subn(" ", unit) if "/" in unit or "www." in unit else (unit, 0)
    if mark := _MARK.match(bare):
        bare = bare[mark.end() :]
    words = _WORD.findall(bare.lower())
    tokens = bare.split()
    n, weight = len(words), len(tokens) + links
    made = TEXT
    if links and tokens and _NAMED.search(tokens[0]):
        made = WORK  # a link under the name of a thing (a compound or numbered one), with or without a remark, is a reference
    elif links and n <= LABEL_WORDS * links:
        made, weight = LINKS, max(1, n) + links
    elif ("#" in bare or "(" in bare) and (tags := len(_TAGGED.findall(bare))) >= LEAST_TAGS and tags >= 0.6 * len(tokens):
        made = TAGS
    elif not links and _SIGN.search(bare) and sum(_SIGN.search(t) is not None for t in tokens) >= 0.2 * sum(t not in _SIGNS for t in tokens):
        made = WORK
    separators = len(_SEPARATOR.findall(bare))
    capitals = sum(t[0].isupper() for t in tokens)
    case = 0 if not capitals else 1 if capitals == 1 else 2 if capitals < 0.5 * n else 3
    closed = unit.endswith((".", "!", "?", ":", ";"))
    shape = ((((made * 8 + min(7, n.bit_length())) * 4 + case) * 3 + (separators > 0) + (separators > 2)) * 3 + min(links, 2)) * 2 + closed
    return shape, words, weight, links


def _repeated(items: list) -> int:
    return sum(len(part) - len(set(part)) for i in range(0, len(items), WINDOW) for part in [items[i : i + WINDOW]])


def evidence(word_lists: list[list[str]], closed: bool) -> float:
    """From -1 (prose) to 1 (keywords) for the words of units of one shape.

    Within a unit, longer words and pairs of neighbouring words count that come back; a pair, which prose hardly ever repeats, doubly. Words that come
    back in the next units count as far as those do in sentences, and nearly in full in units that are none.
    """
    long_lists = [[w for w in words if len(w) > SHORT] for words in word_lists]
    flat = [w for words in long_lists for w in words]
    n = sum(map(len, word_lists))
    if not n:
        return 0.0
    within = sum(map(_repeated, long_lists)) / len(flat) if flat else 0.0
    pairs = [list(zip(words, words[1:], strict=False)) for words in word_lists]
    within += 2 * sum(map(_repeated, pairs)) / max(1, sum(map(len, pairs)))
    among = _repeated(flat) / len(flat) if flat else 0.0
    repetition = within + 0.4 * min(among, within)
    if not closed:
        joined = [p for pair in pairs for p in pair]
        repetition = max(repetition, 0.8 * among, 2 * _repeated(joined) / max(1, len(joined)))
    short = 1 - len(flat) / n
    return max(-1.0, min(1.0, repetition / REPETITION + max(-0.4, min(1.2, (SHORT_SHARE - short) / SHORT_SPAN)) - 1))


def page_groups(text: str) -> tuple[int, list[tuple[int, int, int, float]]]:
    """The weight of a page and ``shape, words, weight, evidence`` of its units by shape.

    A sentence, closed or free of separators, that repeats word by word is looked at once, as notes may repeat themselves; its weight counts every time.
    """
    total = 0
    seen: set[str] = set()
    groups: dict[int, list] = {}
    for unit in units(text):
        shape, words, weight, links = measured(unit)
        total += weight
        group = groups.get(shape)
        if group is None:
            group = groups[shape] = [0, [], 0]
        group[0] += weight
        group[2] += links
        if shape & 1 or shape // 6 % 3 == 0 and len(words) >= 6 and sum(len(w) <= SHORT for w in words) >= 0.2 * len(words):
            known = " ".join(words)
            if known in seen:
                continue
            seen.add(known)
        group[1].append(words)
    out = []
    for shape, (weight, lists, links) in groups.items():
        made = shape // _MADE
        if made == TEXT:
            found = evidence(lists, bool(shape & 1))
        else:
            found = -1.0 if made == WORK else 1.0 if made == TAGS or links >= LEAST_LINKS else 0.0
        out.append((shape, sum(map(len, lists)), weight, found))
    return total, out


def _pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        made = [page_groups(t) for t in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "total": [m[0] for m in made], "groups": [m[1] for m in made]})


def shape_priors(pages: DataFrame) -> DataFrame:
    """``shape, prior``: what the text of a shape mostly carries over the whole corpus, weighted by words; as many rows as there are shapes.

    UNSEEN words of prose are added to each, so that a few words in a small corpus decide nothing either.
    """
    groups = pages.select(F.explode("groups").alias("g")).select("g.*")
    return groups.groupBy("shape").agg(((F.sum(F.col("words") * F.col("evidence")) - UNSEEN) / (F.sum("words") + UNSEEN)).alias("prior"))


def spam_share(text: str | None) -> float:
    """Share of a text that would be a corpus by itself."""
    total, groups = page_groups(text or "")
    score = lambda w, e: w * e + PRIOR * (w * e - UNSEEN) / (w + UNSEEN)
    return sum(weight for shape, w, weight, e in groups if (score(w, e) if shape // _MADE == TEXT else e) > 0) / total if total else 0.0


def page_shares(documents: DataFrame) -> DataFrame:
    """``doc_id, spam_share`` of every document with a text; a repeated id has its largest share.

    Null texts give no row, blank ones a share of 0. Whole texts are read, once; the groups by page and shape are kept in a checkpoint
    from which the corpus statistics of shapes and then the shares are taken.
    """
    rows = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pages = checkpointed(rows.mapInPandas(_pages, f"doc_id bigint, total bigint, groups array<struct<{_GROUP}>>"))
    priors = shape_priors(pages).agg(F.map_from_entries(F.collect_list(F.struct("shape", "prior"))).alias("m")).scalar()
    judged = pages.select("doc_id", "total", "groups", priors.alias("priors"))

    def spam_weight(g):
        text = F.floor(g["shape"] / _MADE) == TEXT
        score = F.when(text, g["words"] * g["evidence"] + PRIOR * F.element_at("priors", g["shape"])).otherwise(g["evidence"])
        return F.when(score > 0, g["weight"]).otherwise(0).cast("bigint")

    spam = F.aggregate(F.transform("groups", spam_weight), F.lit(0).cast("bigint"), lambda a, b: a + b)
    shares = judged.select("doc_id", F.when(F.col("total") > 0, spam / F.col("total")).otherwise(0.0).alias("spam_share"))
    return shares.groupBy("doc_id").agg(F.max("spam_share").alias("spam_share"))


def spam_pages(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id`` of the pages of which more than ``threshold`` of the words are spam."""
    return page_shares(documents).where(F.col("spam_share") > threshold).select("doc_id")
