"""Benchmark decontamination by spaced-seed hashing.

Texts become lower-case word tokens.  A seed is a hash of the words at the
selected places of a mask, the words between them ignored, so that a hit survives
substitutions there.  The seeds of the benchmark items are joined with those of
every place of every document; around each hit the item is laid on the
document and the longest stretch is taken in which the share of equal words is
at least ``similarity``.  An item overlaps a document when such a stretch
has ``least`` words, or all words of an item that is shorter.

The masks are checked (in the tests) to hit every stretch of 16 words with three
substitutions anywhere.  An item shorter than a mask is cut into one more set of places than
words of it may differ, so that one set is left whole; below five words that is
all its words.  So short an item is reported where it stands, but proves nothing (``proves`` is
false): the one word "Yes" stands in half of all texts, and ``clean_documents`` keeps them.

Scripts written without spaces are cut into characters, so an item inside a longer run
is found like any other.

Many items may share a phrase, and a document may hold it many times.  All places where
a seed meets an item are checked together, in batches of bounded size: only those where enough
words of the whole item are equal are measured one by one, and of these only
those that can beat what the item has already.

The benchmark is the stated query set: it is read in blocks of at most about
``block_words`` words, each block sent to the tasks that read the documents, so no
document is shuffled and no document key can be hot.

Defined results: null and empty texts and items overlap nothing; repeated
rows are reported once each; items without words are skipped; an empty table
gives an empty result; items with a null id are reported with a null id.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASKS = ("1110011", "110101001", "1011000101", "11000100000101")
LEAST, SIMILARITY, BLOCK_WORDS = 16, 0.8, 500_000
#: Items of fewer words are no proof of contamination.
PROOF = 5
#: Places that are checked together, and words compared at a time.
HITS, COMPARED = 1 << 20, 1 << 22
# Thai, Lao, Myanmar, Khmer, kana, unified ideographs.
UNSPACED = "".join(f"{chr(a)}-{chr(b)}" for a, b in [(0xE01, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3041, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF),
                                                     (0xF900, 0xFAFF), (0x20000, 0x3FFFF)])
WORD = re.compile(f"[{UNSPACED}]|[^\\W{UNSPACED}]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _hashes(ids: np.ndarray, places: list[int], span: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, whether all selected words are known) at every place where ``span`` words follow."""
    n = len(ids) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h, ok = np.zeros(n, np.uint64), np.ones(n, bool)
    for p in places:
        part = ids[p:p + n]
        h = (h ^ part.astype(np.uint64)) * _MIX
        h ^= h >> np.uint64(29)
        ok &= part >= 0
    return h, ok


class Seeds:
    """Seeds of a block of items."""

    def __init__(self, items: list[tuple], least: int = LEAST, similarity: float = SIMILARITY):
        """items: (id, text)."""
        self.ids, self.items, self.vocabulary = [], [], {}
        for i, text in items:
            w = words(text)
            if w:
                self.ids.append(i)
                self.items.append(np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int64))
        longest_mask = max(map(len, MASKS))
        long = [i for i, w in enumerate(self.items) if len(w) >= longest_mask]
        looked = [([i for i, c in enumerate(m) if c == "1"], len(m), long) for m in MASKS]
        short: dict[int, list[int]] = {}
        for i, w in enumerate(self.items):
            if len(w) < longest_mask:
                short.setdefault(min(least, len(w)), []).append(i)
        for n, some in sorted(short.items()):
            sets = int((1 - similarity) * n + 1e-9) + 1
            looked += [(list(range(k, n, sets)), n, some) for k in range(sets)]
        self.masks = [(p, span) for p, span, _ in looked]
        self.tables = []
        for p, span, those in looked:
            h, item, at = [], [], []
            for i in those:
                x, _ = _hashes(self.items[i], p, span)
                h.append(x)
                item.append(np.full(len(x), i))
                at.append(np.arange(len(x)))
            h = np.concatenate(h) if h else np.zeros(0, np.uint64)
            order = np.argsort(h, kind="stable")
            some = np.zeros(1 << 20, bool)
            some[h >> np.uint64(44)] = True
            self.tables.append((h[order], np.concatenate(item)[order] if item else h.astype(int), np.concatenate(at)[order] if at else h.astype(int), some))

        self.size = np.array([len(x) for x in self.items], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.flat = np.concatenate(self.items) if self.items else np.zeros(0, np.int64)

    def hits(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct (item, place of the item's first word in the document) of the seeds that meet, at most ``HITS`` at a time."""
        for (p, span), (h, item, at, some) in zip(self.masks, self.tables, strict=True):
            if not len(h):
                continue
            x, ok = _hashes(ids, p, span)
            place = np.flatnonzero(ok)
            place = place[some[x[place] >> np.uint64(44)]]
            a, b = np.searchsorted(h, x[place], "left"), np.searchsorted(h, x[place], "right")
            n = b - a
            ends = np.cumsum(n)
            for s in range(0, int(ends[-1]) if len(ends) else 0, HITS):
                flat = np.arange(s, min(s + HITS, int(ends[-1])))
                own = np.searchsorted(ends, flat, "right")
                k = a[own] + flat - (ends[own] - n[own])
                both = np.unique(item[k].astype(np.int64) << 34 | place[own] - at[k] + (1 << 33))
                yield both >> 34, (both & ((1 << 34) - 1)) - (1 << 33)

    def equal(self, ids: np.ndarray, item: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How many words of each item, laid on the document at its place, are equal."""
        lo, hi = np.maximum(0, -start), np.minimum(self.size[item], len(ids) - start)
        n = np.maximum(hi - lo, 0)
        out, ends = np.zeros(len(item), np.int64), np.cumsum(n)
        a = 0
        while a < len(item):
            z = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + COMPARED, "right")))
            m = n[a:z]
            place = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(lo[a:z], m)
            same = self.flat[np.repeat(self.first[item[a:z]], m) + place] == ids[np.repeat(start[a:z], m) + place]
            out[a:z] = np.bincount(np.repeat(np.arange(z - a), m), weights=same, minlength=z - a)
            a = z
        return out

    def overlaps(self, text: str | None, least: int, similarity: float, proof: int = 0) -> list[tuple]:
        """(item id, words of the stretch, equal words, its first word in the document, whether the item has
        ``PROOF`` words), the best per item; ``proof``: items of fewer words are left out."""
        get = self.vocabulary.get
        found = words(text)
        ids = np.fromiter((get(w, -1) for w in found), np.int64, len(found))
        best: dict[int, tuple] = {}
        size = np.zeros(len(self.items), np.int64)  # words of the best stretch of each item
        for item, start in self.hits(ids):
            keep = (size[item] < self.size[item]) & (self.size[item] >= proof)
            item, start = item[keep], start[keep]
            equal = self.equal(ids, item, start)
            # a stretch of n words holds similarity * n equal ones at least, of all that are equal here
            can = np.floor(equal / similarity + 1e-9).astype(np.int64) if similarity else np.full(len(equal), 1 << 40)
            keep = (can >= np.minimum(least, self.size[item])) & (can > size[item])
            for i, s, c in zip(item[keep].tolist(), start[keep].tolist(), can[keep].tolist(), strict=True):
                if c <= size[i]:
                    continue
                w = self.items[i]
                a, b = max(0, -s), min(len(w), len(ids) - s)
                same = w[a:b] == ids[s + a:s + b]
                lo, hi = longest(same, similarity)
                if hi - lo >= min(least, len(w)) and hi - lo > size[i]:
                    best[i] = (hi - lo, int(same[lo:hi].sum()), s + a + lo, len(w) >= PROOF)
                    size[i] = hi - lo
        return [(self.ids[i], *x) for i, x in sorted(best.items())]


def longest(same: np.ndarray, similarity: float) -> tuple[int, int]:
    """The longest stretch [lo, hi) whose share of true is at least ``similarity``."""
    s = np.concatenate(([0.0], np.cumsum(np.where(same, 1 - similarity, -similarity))))
    starts = np.flatnonzero(s <= np.minimum.accumulate(s))  # no later place has a lower start
    lo = hi = 0
    for j in range(len(s) - 1, 0, -1):
        if j <= hi - lo:
            break
        k = np.searchsorted(-s[starts], -s[j] - 1e-9)  # starts fall, so the first at or below s[j]
        if k < len(starts) and starts[k] < j and j - starts[k] > hi - lo:
            lo, hi = int(starts[k]), j
    return lo, hi


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple]]:
    """Items in blocks of about ``block_words`` words."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).cast("string").alias("t")).where(F.length("t") > 0)
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-size // (6 * block_words)))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k)
        yield [(r["i"], r["t"]) for r in part.distinct().collect()]


_MADE: dict = {}


def _seeds(sent, least: int, similarity: float) -> Seeds:
    if _MADE.get("of") is not sent:
        _MADE.update(of=sent, seeds=Seeds(sent.value, least, similarity))
    return _MADE["seeds"]


def overlaps(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS,
             id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_id, n_words, n_equal, first_word, proves, similarity: one row per document and item that overlap."""
    from pyspark.sql.pandas.types import to_arrow_type
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind, item_kind = src.schema["doc_id"].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = None
    for block in _blocks(benchmark, item_col, item_text, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seeds = _seeds(sent, least, similarity)
            for b in batches:
                found = [(i, x) for i, t in enumerate(b.column(1)) for x in seeds.overlaps(t.as_py(), least, similarity)]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([x[0] for _, x in found], item_type),
                                                  *[pa.array([x[k] for _, x in found], pa.int64()) for k in (1, 2, 3)],
                                                  pa.array([x[4] for _, x in found], pa.bool_())],
                                                 names=["doc_id", "item_id", "n_words", "n_equal", "first_word", "proves"])

        part = src.mapInArrow(run, f"doc_id {kind}, item_id {item_kind}, n_words long, n_equal long, first_word long, proves boolean")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("similarity", F.col("n_equal") / F.col("n_words"))


def clean_documents(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, similarity: float = SIMILARITY, block_words: int = BLOCK_WORDS,
                    text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that overlap no benchmark item of ``PROOF`` words or more, all columns as they are."""
    cols = docs.columns
    at = cols.index(text_col)
    out = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    for block in _blocks(benchmark, item_col, item_text, block_words):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            seeds = _seeds(sent, least, similarity)
            for b in batches:
                yield b.filter(pa.array([not seeds.overlaps(t.as_py(), least, similarity, PROOF) for t in b.column(at)], pa.bool_()))

        out = out.mapInArrow(run, out.schema)
    return out.toDF(*cols)
