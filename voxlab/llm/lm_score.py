"""Cross-entropy difference of matched n-gram models.

Two bigram models of the same order, smoothing and vocabulary are counted over
the corpus: the target one over the documents marked as wanted, the background
one over all.  The vocabulary is every word that the corpus holds at least ``least``
times; all other words are one symbol in both.  A document's score is the mean over
its tokens of target loss minus background loss (nats; lower is more like the target).

Every count is exact and grows with the corpus; no table is sent to the tasks.
Each task cuts its documents into blocks of about a million tokens and writes them as
numbers of the block's own word list.  The lists are dealt into parts by hash; each part
adds up its words, drops the rare ones and answers every block with the corpus numbers
of its words.  A block then asks in the same way for the totals of each distinct bigram,
word and context it holds, from which it scores its documents.  A frequent bigram
is one entry a block, however often it occurs, and the parts grow in number with the
corpus.

Defined results: a null or empty text has 0 tokens and null scores; without
wanted documents the target model is the uniform one; repeated rows count each time;
rows with a null id are background and scored.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage

LEAST, WEIGHT, FLOOR = 2, 0.6, 0.5
#: A block ends after so many tokens, distinct words or documents, a part holds about so many tokens' bigrams.
BLOCK_TOKENS, BLOCK_WORDS, BLOCK_DOCS, PART_TOKENS, PARTS = 2_000_000, 400_000, 50_000, 4_000_000, 512
#: First numbers: marks of word and context totals, of a document's start, of words out of the vocabulary.
WORDS, CONTEXTS, START, UNKNOWN, FIRST = 0, 1, 2, 3, 4
DOC, WORD, WANTED, TOTALS = 0, 1, 2, 3
_ZSTD = pa.Codec("zstd")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def tokens(text: str | None) -> list[str]:
    return text.lower().split() if text else []


def squeezed(x: bytes) -> bytes:
    """The length and the bytes, compressed."""
    return len(x).to_bytes(5, "little") + _ZSTD.compress(x, asbytes=True)


def spread(x: bytes) -> bytes:
    return _ZSTD.decompress(x[5:], decompressed_size=int.from_bytes(x[:5], "little"), asbytes=True)


def packed(x: np.ndarray) -> bytes:
    """Numbers from 0 in the fewest whole bytes each: the lowest bytes of all, then the next ones."""
    width = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return squeezed(planes)


def unpacked(x: bytes, n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    if n:
        for k, plane in enumerate(np.frombuffer(spread(x), np.uint8).reshape(-1, n)):
            out |= plane.astype(np.int64) << (8 * k)
    return out


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents (block, row, id, n, codes) as numbers of their block's word list, and the lists (block, n, codes: counts, words)."""
    names = ["block", "row", "id", "n", "codes", "words"]
    part, seq = TaskContext.get().partitionId() << 32, 0
    found: defaultdict[str, int] = defaultdict()
    found.default_factory = found.__len__
    counts: list[np.ndarray] = []
    held, rows, kind = 0, 0, pa.null()

    def word_list() -> pa.RecordBatch:
        total = np.bincount(np.concatenate(counts), minlength=len(found))
        return pa.RecordBatch.from_arrays([pa.array([part + seq], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, kind), pa.array([len(found)], pa.int64()),
                                           pa.array([packed(total)], pa.binary()), pa.array([squeezed("\n".join(found).encode())], pa.binary())], names=names)

    for b in batches:
        kind = b.column(0).type
        block, row, n, codes = [], [], [], []
        for t in b.column(1):
            if held > BLOCK_TOKENS or len(found) > BLOCK_WORDS or rows >= BLOCK_DOCS:
                if found:
                    yield word_list()
                found.clear()
                counts.clear()
                held, rows, seq = 0, 0, seq + 1
            words = tokens(t.as_py())
            own = np.fromiter(map(found.__getitem__, words), np.int32, len(words))
            counts.append(own)
            block.append(part + seq)
            row.append(rows)
            n.append(len(own))
            codes.append(packed(own))
            held, rows = held + len(own), rows + 1
        yield pa.RecordBatch.from_arrays([pa.array(block, pa.int64()), pa.array(row, pa.int32()), b.column(0), pa.array(n, pa.int64()),
                                          pa.array(codes, pa.binary()), pa.nulls(len(row), pa.binary())], names=names)
    if found:
        yield word_list()


def _words(x: bytes) -> list[str]:
    return spread(x).decode().split("\n")


def _dealt(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """Word lists (block, n, codes, words) cut into parts: block, part, n, places in the list, words, counts."""
    for b in batches:
        for block, n, codes, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words = np.array(_words(text), object)
            part = np.fromiter((zlib.crc32(w.encode()) % parts for w in words), np.int64, n)
            order = np.argsort(part, kind="stable")
            own, starts = np.unique(part[order], return_index=True)
            places, counts = np.split(order, starts[1:]), unpacked(codes, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(own), block)), pa.array(own, pa.int32()), pa.array([len(x) for x in places], pa.int64()),
                 pa.array([packed(np.diff(x, prepend=0)) for x in places], pa.binary()), pa.array([squeezed("\n".join(words[x]).encode()) for x in places], pa.binary()),
                 pa.array([packed(counts[x]) for x in places], pa.binary())], names=["block", "part", "n", "codes", "words", "c"])


def _totals(group: pa.Table) -> Counter:
    total: Counter = Counter()
    for n, words, c in zip(group["n"].to_pylist(), group["words"].to_pylist(), group["c"].to_pylist(), strict=True):
        for w, k in zip(_words(words), unpacked(c, n).tolist(), strict=True):
            total[w] += k
    return total


def _counted(group: pa.Table) -> pa.Table:
    total = _totals(group)
    return pa.table([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])


def _numbered(group: pa.Table, parts: int, least: int, kept: frozenset[str] | None) -> pa.Table:
    """The words of one part as numbers, sent back to the blocks; ``known``, once, is how many words are kept."""
    part = group["part"][0].as_py()
    words = [w for w, n in _totals(group).items() if n >= least and (kept is None or w in kept)]
    if FIRST + len(words) * parts >= 1 << 31:
        raise ValueError("word numbers take 31 bits")
    number = {w: FIRST + i * parts + part for i, w in enumerate(words)}
    t = [packed(np.array([number.get(w, UNKNOWN) for w in _words(x)], np.int64)) for x in group["words"].to_pylist()]
    return pa.table([group["block"], group["n"], group["codes"], pa.array(t, pa.binary()), pa.array([len(words)] + [0] * (len(t) - 1), pa.int64())],
                    names=["block", "n", "codes", "t", "known"])


class Block:
    """A block's documents and the distinct entries (first, second) whose totals it needs, ordered by part."""

    def __init__(self, group: pa.Table, parts: int):
        kind = group["kind"].to_numpy()
        pick = lambda k: group.filter(pa.array(kind == k))
        self.docs, words, wanted = pick(DOC).sort_by("row"), pick(WORD), pick(WANTED)
        self.totals, self.size = pick(TOTALS), self.docs["n"].to_numpy()
        number = np.full(sum(words["n"].to_pylist()), UNKNOWN, np.int64)
        for n, places, t in zip(*(words[x].to_pylist() for x in ("n", "codes", "t")), strict=True):
            number[np.cumsum(unpacked(places, n))] = unpacked(t, n)
        self.own, place = np.unique(number, return_inverse=True)
        k = len(self.own)  # stands for the start
        codes = [unpacked(c.as_py(), n) for c, n in zip(self.docs["codes"], self.size.tolist(), strict=True)]
        ids = place[np.concatenate(codes)] if len(number) else np.zeros(0, np.int64)
        self.doc = np.repeat(np.arange(len(self.size)), self.size)
        before = np.concatenate(([k], ids[:-1])) if len(ids) else ids
        before[1:][self.doc[1:] != self.doc[:-1]] = k
        pairs, self.at = np.unique(before * (k + 1) + ids, return_inverse=True)
        self.first, self.second = pairs // (k + 1), pairs % (k + 1)
        target = np.isin(self.doc, wanted["row"].to_numpy())
        named = np.append(self.own, START)
        a = np.concatenate((named[self.first], np.full(k, WORDS), np.full(k + 1, CONTEXTS)))
        b = np.concatenate((named[self.second], self.own, named))
        counts = [np.concatenate((np.bincount(self.at[s], minlength=len(pairs)), np.bincount(ids[s], minlength=k), np.bincount(before[s], minlength=k + 1)))
                  for s in (target, slice(None))]
        h = (a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)) * _MIX
        part = ((h ^ h >> np.uint64(29)) * _MIX >> np.uint64(33)).astype(np.int64) % parts
        self.order = np.lexsort((b, a, part))
        self.a, self.b, self.counts = a[self.order], b[self.order], [c[self.order] for c in counts]
        self.parts, self.starts = np.unique(part[self.order], return_index=True)
        self.ends = np.append(self.starts[1:], len(a))

    def asked(self, block: int) -> pa.Table:
        cut = list(zip(self.starts.tolist(), self.ends.tolist(), strict=True))
        column = lambda x: pa.array([packed(x[s:e]) for s, e in cut], pa.binary())
        first = pa.array([packed(np.diff(self.a[s:e], prepend=0)) for s, e in cut], pa.binary())
        return pa.table([pa.array(np.full(len(cut), block)), pa.array(self.parts, pa.int32()), pa.array(self.ends - self.starts, pa.int64()),
                         first, column(self.b), column(self.counts[0]), column(self.counts[1])], names=["block", "part", "n", "a", "b", "t", "c"])

    def losses(self, sums: tuple[float, float], weight: float) -> list[np.ndarray]:
        """Mean loss of each document under the target (0) and background (1) model; ``sums`` are the words' smoothed totals."""
        answers = {p: (t, c) for p, t, c in zip(self.totals["row"].to_pylist(), self.totals["t"].to_pylist(), self.totals["c"].to_pylist(), strict=True)}
        pairs, k, out = len(self.first), len(self.own), []
        for m in (0, 1):
            total = np.empty(len(self.order))
            total[self.order] = np.concatenate([unpacked(answers[p][m], n) for p, n in zip(self.parts.tolist(), (self.ends - self.starts).tolist(), strict=True)])
            bigram, word, context = total[:pairs], total[pairs:pairs + k], total[pairs + k:]
            c = context[self.first]
            near = np.divide(bigram, c, out=np.zeros(pairs), where=c > 0)
            w = np.where(c > 0, weight, 0.0)
            loss = -np.log(w * near + (1 - w) * (word[self.second] + FLOOR) / sums[m])
            out.append(np.bincount(self.doc, loss[self.at], minlength=len(self.size)) / np.maximum(self.size, 1))
        return out


def _added(group: pa.Table) -> pa.Table:
    """What the blocks asked in one part, answered with the totals over all blocks."""
    sizes = group["n"].to_pylist()
    read = lambda name: [unpacked(x, n) for x, n in zip(group[name].to_pylist(), sizes, strict=True)]
    key = np.concatenate([np.cumsum(x) for x in read("a")]) << 32 | np.concatenate(read("b"))
    _, at = np.unique(key, return_inverse=True)
    ends = np.cumsum(sizes)[:-1]
    total = [np.split(np.bincount(at, np.concatenate(read(name))).astype(np.int64)[at], ends) for name in ("t", "c")]
    return pa.table([group["block"], group["part"], *[pa.array([packed(x) for x in s], pa.binary()) for s in total]], names=["block", "row", "t", "c"])


def cross_entropy_difference(docs: DataFrame, wanted: DataFrame, vocabulary: int | None = None, least: int | None = None, weight: float = WEIGHT,
                             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference of every row.

    ``wanted`` holds the ids of the target documents.  The vocabulary is the words found at least ``least``
    times (2), or, if ``vocabulary`` is given, that many symbols: the most frequent words and the one for all others.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["id"].dataType.simpleString()
    coded = stage(src.mapInArrow(_coded, f"block long, row int, id {kind}, n long, codes binary, words binary"), "coded")
    texts, lists = coded.where(F.col("words").isNull()), coded.where(F.col("words").isNotNull())
    held = texts.agg(F.sum("n")).first()[0] or 0
    parts = max(PARTS, -(-held // PART_TOKENS))
    least = (LEAST if vocabulary is None else 1) if least is None else least
    dealt = lists.select("block", "n", "codes", "words").mapInArrow(lambda batches: _dealt(batches, parts),
                                                                   "block long, part int, n long, codes binary, words binary, c binary").groupBy("part")
    kept = None
    if vocabulary is not None:
        top = dealt.applyInArrow(_counted, "word string, n long").orderBy(F.col("n").desc(), "word").limit(vocabulary - 1)
        kept = frozenset(r[0] for r in top.select("word").collect())  # as many as were asked for
    numbers = stage(dealt.applyInArrow(lambda group: _numbered(group, parts, least, kept), "block long, n long, codes binary, t binary, known long"), "numbers")
    size = numbers.agg(F.sum("known")).first()[0] or 0
    # only ids meet the wanted ids; neither side is bounded, so the join is a sort-merge one at every size
    marked = stage(texts.select("block", "row", "id", "n").join(wanted.select(F.col(id_col).alias("_w")).distinct().hint("merge"), F.col("id") == F.col("_w"))
                   .select("block", "row", "n"), "wanted")
    smoothed = FLOOR * (size + 1)
    sums = ((marked.agg(F.sum("n")).first()[0] or 0) + smoothed, held + smoothed)

    def together(*of: tuple[DataFrame, int]) -> DataFrame:
        out = None
        for df, what in of:
            part = df.withColumn("kind", F.lit(what))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out.groupBy("block")

    texts, numbers = texts.drop("words"), numbers.drop("known")

    def ask(group: pa.Table) -> pa.Table:
        return Block(group, parts).asked(group["block"][0].as_py())

    asked = together((texts.drop("id"), DOC), (numbers, WORD), (marked, WANTED)).applyInArrow(ask, "block long, part int, n long, a binary, b binary, t binary, c binary")
    totals = asked.groupBy("part").applyInArrow(_added, "block long, row int, t binary, c binary")

    def score(group: pa.Table) -> pa.Table:
        made = Block(group, parts)
        none = pa.array(made.size == 0)
        loss = [pa.array(np.asarray(x), mask=none.to_numpy(zero_copy_only=False)) for x in made.losses(sums, weight)]
        return pa.table([made.docs["id"], pa.array(made.size, pa.int64()), *loss], names=["id", "n_tokens", "target_loss", "background_loss"])

    return together((texts, DOC), (numbers, WORD), (marked, WANTED), (totals, TOTALS)) \
        .applyInArrow(score, f"id {kind}, n_tokens long, target_loss double, background_loss double") \
        .withColumn("difference", F.col("target_loss") - F.col("background_loss")).withColumnRenamed("id", id_col)
