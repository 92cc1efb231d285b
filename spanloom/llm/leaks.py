"""Evaluation passages leaking into a corpus: pigeonhole pieces and Myers checks.

A passage is ``min_words`` successive words of an item.  Split into
``budget + 1`` pieces, it keeps one of them unchanged under at most ``budget``
edits; so the pieces of every passage go into one Aho-Corasick automaton, and a
pass over a document finds all their exact hits.  Around each hit Myers'
bit-parallel distance of the whole passage decides whether the document holds
it, and with how many edits.
"""

from __future__ import annotations

import functools
import html
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import checkpointed

MIN_WORDS = 12
BUDGET = 1
#: Eval items are matched in blocks of at most this many pieces: the bound of what one task closure carries.
BLOCK_PIECES = 100_000

_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")
_BREAK = re.compile(r"</?(?:br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr|section|article)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,10});")
_GAP = re.compile(r"[\W_]+")


def _without_comments(text: str) -> str:
    """``text`` without closed comments of any length, in one pass; an open one stays."""
    kept, at = [], 0
    while (lo := text.find("<!--", at)) >= 0 and (hi := text.find("-->", lo + 4)) >= 0:
        kept.append(text[at:lo])
        at = hi + 3
    return "".join([*kept, text[at:]])


def plain_words(text: str) -> str:
    """Case-folded words joined by one space; markup and invisible characters gone."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m[0]), text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    if "<" in text:
        text = _TAG.sub("", _BREAK.sub(" ", _without_comments(text)))
    return _GAP.sub(" ", text.casefold()).strip()


@functools.lru_cache(maxsize=4096)
def _masks(pattern: str) -> dict[str, int]:
    """Per character the places where the pattern has it, as bits."""
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


def myers_distance(pattern: str, text: str, most: int | None = None) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text``; beyond ``most``, if given, any number above it.

    The distance of a column can fall by one a column at most, so where the rest
    of the text can't bring it down to ``most`` the scan stops.
    """
    m = len(pattern)
    if not m:
        return 0
    peq = _masks(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = full, 0, m, m
    left = len(text)
    for c in text:
        if most is not None and best > most and score - left > most:
            break
        left -= 1
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        score += (ph & top > 0) - (mh & top > 0)
        best = min(best, score)
        ph = ph << 1 & full  # a match may begin at any place of the text
        pv, mv = (mh << 1 | ~(xv | ph)) & full, ph & xv
    return best


class _Item:
    """An item's words without blanks, with the offset of every word's start."""

    __slots__ = ("key", "starts", "stream")

    def __init__(self, key, text: str):
        words = plain_words(text).split(" ")
        self.key, self.stream = key, "".join(words)
        self.starts = np.concatenate(([0], np.cumsum([len(w) for w in words]))).tolist()

    def words(self) -> int:
        return len(self.starts) - 1


class LeakMatcher:
    """All items of one block, the pieces of all their passages in one automaton."""

    def __init__(self, items: list[tuple], min_words: int = MIN_WORDS, budget: int = BUDGET):
        import ahocorasick

        self.min_words, self.budget = min_words, budget
        self.cuts = [k * min_words // (budget + 1) for k in range(budget + 2)]
        fine = [k * min_words // (2 * budget + 2) for k in range(2 * budget + 3)]
        self.fine = [(i, j) for i, j in zip(fine, fine[1:]) if i < j]
        self.items = [x for x in (_Item(k, t) for k, t in items) if x.words() >= min_words]
        pieces: dict[str, set[tuple[int, int, int]]] = {}
        for n, item in enumerate(self.items):
            for w in range(item.words() - min_words + 1):
                for lo, hi in zip(self.cuts, self.cuts[1:]):
                    pieces.setdefault(item.stream[item.starts[w + lo] : item.starts[w + hi]], set()).add((n, w + lo, w + hi))
        pieces.pop("", None)
        self.automaton = ahocorasick.Automaton()
        for piece, at in pieces.items():
            self.automaton.add_word(piece, sorted(at))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def find(self, text: str) -> dict[int, int]:
        """Item number -> longest run of whole consecutive words found in ``text``, of ``min_words`` at least."""
        return {n: run for n, (_, run) in self.passages(plain_words(text)).items() if run >= self.min_words}

    def passages(self, spaced: str) -> dict[int, tuple[int, int]]:
        """Item number -> (least edits of a passage, longest unchanged run of whole words), for plain words.

        Edits count characters; blanks are none, so a word may be broken anywhere.
        """
        found: dict[int, int] = {}
        if self.empty:
            return {}
        stream = spaced.replace(" ", "")
        edges, seen, runs = None, {}, {}
        for end, places in self.automaton.iter(stream):
            for n, p, q in places:
                item = self.items[n]
                offset = end + 1 - item.starts[q]  # of the item's start in the stream
                if item.starts[q] <= seen.get((n, offset), -1):
                    continue  # inside a stretch that was looked at
                if edges is None:
                    edges = {0, *np.cumsum([len(x) for x in spaced.split(" ")]).tolist()}
                lo, hi = self._extend(item, stream, offset, item.starts[p], item.starts[q])
                seen[n, offset] = hi
                run = self._run(item, lo, hi, offset, edges)
                runs[n] = max(runs.get(n, 0), run[1] - run[0] if run else 0)
                for w in self._passages_of(item, lo, hi) if found.get(n) != 0 else ():
                    a, b = item.starts[w], item.starts[w + self.min_words]
                    at = max(0, offset + a - self.budget)
                    region = stream[at : max(at, offset + b + self.budget)]
                    # an edit spoils one of the finer pieces at most, so all but ``budget`` of them must stand in the region
                    if sum(item.stream[item.starts[w + i] : item.starts[w + j]] in region for i, j in self.fine) < len(self.fine) - self.budget:
                        continue
                    edits = myers_distance(item.stream[a:b], region, self.budget)
                    if edits <= min(self.budget, found.get(n, self.budget)):
                        found[n] = edits
        return {n: (edits, runs.get(n, 0)) for n, edits in found.items()}

    def _passages_of(self, item: _Item, lo: int, hi: int) -> list[int]:
        """First words of the passages that an unchanged stretch of the item may belong to.

        Of the passages that begin in the stretch the first needs the fewest words
        beyond it, of those that end in it the last; where one of the others is
        within the budget that one is too, by the same alignment.
        """
        p, q = bisect_left(item.starts, lo), bisect_right(item.starts, hi) - 1
        last = item.words() - self.min_words
        near: set[int] = set()
        for a, b in zip(self.cuts, self.cuts[1:]):
            near.update(range(max(0, p - a), min(last, q - b) + 1))
        inside = [w for w in near if q - self.min_words < w < p]
        begin, close = [w for w in near if w >= p], [w for w in near if w <= q - self.min_words]
        return sorted({*inside, *([min(begin)] if begin else ()), *([max(close)] if close else ())})

    @staticmethod
    def _extend(item: _Item, stream: str, offset: int, lo: int, hi: int) -> tuple[int, int]:
        """The longest stretch around [lo, hi) of the item that the stream repeats."""
        own, most = item.stream, min(len(item.stream), len(stream) - offset)
        while lo > 0 and lo + offset > 0 and own[lo - 1] == stream[lo + offset - 1]:
            lo -= 1
        while hi < most and own[hi] == stream[hi + offset]:
            hi += 1
        return lo, hi

    @staticmethod
    def _run(item: _Item, lo: int, hi: int, offset: int, edges: set[int]) -> tuple[int, int] | None:
        """First and last+1 whole word of the item in [lo, hi), whole in the document too."""
        first, last = bisect_left(item.starts, lo), bisect_right(item.starts, hi) - 1
        while first < last and item.starts[first] + offset not in edges:
            first += 1
        while last > first and item.starts[last] + offset not in edges:
            last -= 1
        return (first, last) if last > first else None


def _blocks(items: DataFrame, item_id: str, text: str, pieces_per_word: int, limit: int) -> Iterator[list[tuple]]:
    block, pieces = [], 0
    query = items.select(F.col(item_id).alias("k"), F.col(text).cast("string").alias("t")).where("k is not null and t is not null")
    for row in query.distinct().toLocalIterator():
        n = max(1, len(row.t.split()) * pieces_per_word)
        if block and pieces + n > limit:
            yield block
            block, pieces = [], 0
        block.append((row.k, row.t))
        pieces += n
    if block:
        yield block


def find_passages(
    documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str,
    min_words: int = MIN_WORDS, budget: int = BUDGET, block_pieces: int = BLOCK_PIECES,
) -> DataFrame:
    """``(doc_id, item_id, distance, run_words)`` of documents holding an item's passage with at most ``budget`` edits.

    A passage is ``min_words`` consecutive words of the item; letter case,
    punctuation, spacing, invisible characters and markup don't matter.
    ``distance`` is the least number of changed characters, ``run_words`` the
    longest run of the item's words that stand unchanged and whole.  The items
    are the stated query set: they pass the driver in blocks of at most
    ``block_pieces`` pieces, every block against all documents, whose words are
    made plain once.  Null or empty texts, null ids and items of fewer words
    match nothing; documents are never cut; equal rows give equal rows once; an
    empty side gives an empty result.
    """
    schema = "doc_id bigint, item_id bigint, distance int, run_words int"
    docs = documents.select(F.col(doc_id).cast("bigint").alias("d"), F.col(text).cast("string").alias("t")).where("d is not null and t is not null")
    blocks = list(_blocks(items, item_id, item_text, 1 if budget == 0 else 2, block_pieces))
    if not blocks:
        return documents.sparkSession.createDataFrame([], schema)

    def make_plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([plain_words(t) for t in batch.column(1).to_pylist()], pa.string())], names=["d", "t"])

    if many := len(blocks) > 1:
        docs = checkpointed(docs.mapInArrow(make_plain, "d bigint, t string"))
    result = None
    for block in blocks:

        def scan(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            matcher = LeakMatcher(block, min_words, budget)
            for batch in batches:
                rows = []
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    rows += [(d, matcher.items[n].key, *x) for n, x in matcher.passages(t if many else plain_words(t)).items()]
                cols = list(zip(*rows)) or [[]] * 4
                types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=["doc_id", "item_id", "distance", "run_words"])

        part = docs.mapInArrow(scan, schema)
        result = part if result is None else result.unionByName(part)
    return result.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.max("run_words").alias("run_words"))


def find_leaks(
    documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str,
    min_words: int = MIN_WORDS, budget: int = BUDGET, block_pieces: int = BLOCK_PIECES,
) -> DataFrame:
    """``(doc_id, item_id, run_words)``: the passages of ``find_passages`` of which ``min_words`` whole words stand unchanged."""
    passages = find_passages(documents, doc_id, text, items, item_id, item_text, min_words, budget, block_pieces)
    return passages.where(F.col("run_words") >= min_words).drop("distance")
