"""Language identification with word-first backoff.

A known word scores by its per-language log frequency.  An unseen word falls
back to its character n-grams, the longest length of which any is known, then
shorter ones.  The text's language has the highest sum; its score is that
language's share of the summed likelihoods.

The model is learnt from a sample of the labelled rows: of each language about
``max_rows`` rows and ``max_chars`` characters at most (a fixed hash of the id chooses
them), so a language of few documents is learnt from all of them, however many
rows others have.  It holds every word that its language's sample has ``LEAST``
times and every n-gram that it has ``LEAST_GRAM`` times; nothing else is left out, and what is
rarer is what the backoff is for.  Every whole text is predicted.

Defined results: ``und`` with score 0 for a null text, one without letters, or
when there is nothing to learn from; a null language is no label; a null id
is predicted but never learnt from; repeated rows are predicted row by row;
of languages with equal sums the first by code point is taken.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chosen, held_out, may_learn, stage

MAX_ROWS, MAX_CHARS, LEAST, LEAST_GRAM, LENGTHS = 5_000, 12_000_000, 2, 5, (5, 4, 3, 2, 1)
#: Unseen words a worker remembers.
CACHED = 200_000
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of the word between boundary marks; single characters without the marks."""
    s = f" {word} " if n > 1 else word
    return [s[i:i + n] for i in range(len(s) - n + 1)]


class Model:
    """Log frequencies per language of words and of n-grams by length."""

    def __init__(self, counted: list[tuple[str, int, str, int]]):
        """counted: (item, kind, language, count); kind 0 is a word, n an n-gram."""
        self.langs = sorted({r[2] for r in counted})
        at = {x: i for i, x in enumerate(self.langs)}
        #: by kind: number of each item and the log frequencies by number
        self.tables: dict[int, tuple[dict[str, int], np.ndarray]] = {}
        for kind in {0, *(r[1] for r in counted)}:
            own = [r for r in counted if r[1] == kind]
            number: dict[str, int] = {}
            place = [number.setdefault(r[0], len(number)) for r in own]
            n = np.full((len(number), len(at)), 0.1)
            np.add.at(n, (place, [at[r[2]] for r in own]), [r[3] for r in own])
            self.tables[kind] = number, np.log(n / n.sum(axis=0)).astype(np.float32)
        known, rows = self.tables[0]
        self.known, self.rows = known, rows.astype(float)
        self.unseen: dict[str, np.ndarray] = {}

    def backoff(self, word: str) -> np.ndarray:
        got = self.unseen.get(word)
        if got is None:
            got = np.zeros(len(self.langs))
            for n in LENGTHS:
                number, logs = self.tables.get(n, ({}, got))
                found = [x for x in map(number.get, grams(word, n)) if x is not None]
                if found:
                    got = logs[found].mean(axis=0, dtype=float)
                    break
            if len(self.unseen) >= CACHED:
                self.unseen.clear()
            if len(word) <= 40:
                self.unseen[word] = got
        return got

    def predict(self, text: str | None) -> tuple[str, float]:
        found = words(text)
        if not self.langs or not any(w.isalpha() or any(map(str.isalpha, w)) for w in found):
            return "und", 0.0
        ids = list(map(self.known.get, found))
        at = np.array([i for i in ids if i is not None], np.int64)
        total = self.rows[at].sum(axis=0) if len(at) else np.zeros(len(self.langs))
        if len(at) < len(found):
            total = total + sum(map(self.backoff, [w for w, i in zip(found, ids) if i is None]))
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts per language, summed over a task before they are shuffled."""
    def out(found: Counter) -> pa.RecordBatch:
        keys = list(found)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()),
                                           pa.array(found.values(), pa.int64())], names=["item", "lang", "n"])
    found: Counter = Counter()
    for b in batches:
        for t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for w, n in Counter(words(t)).items():
                found[w, lang] += n
        if len(found) > 500_000:
            yield out(found)
            found.clear()
    yield out(found)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found: Counter = Counter()
        for w, lang, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            for size in LENGTHS:
                for g in grams(w, size):
                    found[g, size, lang] += n
        keys = list(found)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()),
                                          pa.array([k[2] for k in keys], pa.string()), pa.array(found.values(), pa.int64())], names=["item", "kind", "lang", "n"])


def learn(docs: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, least: int = LEAST, least_gram: int = LEAST_GRAM, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, int, str, int]]:
    """(item, kind, language, count) of the words and n-grams of the model.

    The sample bounds them: ``max_chars`` / ``least`` words of each language at most.
    """
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"))
    own = own.where(may_learn(F.col("id")) & F.col("lang").isNotNull())
    size = own.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("t")).alias("c")).collect()  # one row a language
    share = F.lit(0.0)
    for r in size:
        share = F.when(F.col("lang") == r["lang"], F.lit(float(min(1.0, max_rows / r["n"], max_chars / max(1, r["c"] or 0))))).otherwise(share)
    some = own.where(chosen(F.col("id"), share)).select("t", "lang")
    counted = stage(some.mapInArrow(_counts, "item string, lang string, n long").groupBy("item", "lang").agg(F.sum("n").alias("n")), "words")
    top = counted.where(F.col("n") >= least).select("item", F.lit(0).alias("kind"), "lang", "n")
    of_words = counted.mapInArrow(_gram_counts, "item string, kind int, lang string, n long").groupBy("item", "kind", "lang").agg(F.sum("n").alias("n"))
    table = top.unionByName(of_words.where(F.col("n") >= least_gram)).toPandas()
    return list(zip(*(table[c].tolist() for c in ("item", "kind", "lang", "n")), strict=True))


_MADE: dict = {}


def identify(docs: DataFrame, max_rows: int = MAX_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    spark = docs.sparkSession
    counted = spark.sparkContext.broadcast(sorted(learn(docs, max_rows, id_col=id_col, text_col=text_col, lang_col=lang_col)))  # bounded by the sample
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if _MADE.get("of") is not counted:
            _MADE.update(of=counted, model=Model(counted.value))
        model = _MADE["model"]
        for b in batches:
            found = [model.predict(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    kind = src.schema["doc_id"].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double") \
        .select(F.col("doc_id").alias(id_col), held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
