"""Cross-tokenizer alignment by white-space anchors.

Every text is tokenised in full by two tokenizers, A (byte-level BPE) and B
(sentencepiece), over the same bytes: space + text.  Where a token of each ends at the
same byte and the next token of each begins with a space, the document is cut;
between two such verified ends lies a window, a pair of id tuples.  The
same windows come again and again, so a worker aligns each id tuple pair once and
remembers its groups and links.  A link is a pair of tokens whose byte ranges overlap;
a group lies between two neighbouring bytes where tokens of both end.

Documents are worked off in blocks of about ``BLOCK_TOKENS`` tokens.  A block writes, per
document, the numbers of its windows; and once the links of each window and how
often the block holds each pair of ids.  Those counts are added up over all
blocks, and every block gets back the counts of its own pairs: what is shuffled is
distinct pairs a block, not links.  No table of pairs is broadcast.

A's ids come from tiktoken, built from the vocabulary of the same file, where it
gives those of the tokenizers library: for texts of characters whose class is the
same in every Unicode version, and only if the vocabulary has the form for which
both merge alike (checked when it is loaded).  Other texts go to the library itself.

Windows are cut and told apart for many documents at once, by hashes that are then
compared id by id, so only windows that differ within a batch are looked up.

Defined results: texts null, empty, or that either tokenizer doesn't reproduce byte
for byte have no tokens: zeros and an empty digest; strings of special tokens
are plain text; repeated rows count as often as they occur; an id of
null is an id like others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

#: A block is closed when it holds so many tokens of A, or so many different windows.
BLOCK_TOKENS, BLOCK_WINDOWS = 1 << 24, 300_000
#: Windows that a worker remembers; a full table is emptied.  Windows of more bytes of ids are not remembered.
MAX_WINDOWS, LONGEST = 400_000, 2048
#: Documents whose windows are cut at a time, and their characters.
TEXTS, CHARACTERS = 1024, 1 << 21
# Fixed value: the word rule of byte-level vocabularies.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Latin, Greek, Cyrillic, kana and unified ideographs, punctuation: as old as Unicode itself.
_OLD = [(0x00, 0x24F), (0x391, 0x3A1), (0x3A3, 0x3C9), (0x410, 0x44F), (0x2010, 0x2027), (0x2030, 0x2046), (0x20AC, 0x20AC), (0x3001, 0x3003), (0x3041, 0x3094),
        (0x30A1, 0x30FA), (0x4E00, 0x9FA5)]
UNSETTLED = re.compile("[^" + "".join(f"{chr(x)}-{chr(y)}" for x, y in _OLD).replace("\\", "") + "]")
#: How sentencepiece writes a space.
MARK = chr(0x2581)
#: Bits of an id of B in a link code, and what marks an id of B in a window.
B_BITS, OF_B = 20, 1 << 30

_LOADED: dict = {}


def byte_of_symbol() -> dict[str, int]:
    """The byte that each printable character of a byte-level vocabulary stands for."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def merges_alike(spec: bytes) -> bool:
    """Whether tiktoken merges like the tokenizers library under this file.

    tiktoken merges any two neighbours that make a token, the library only those that are
    a merge rule.  Where the rules make every token of its own bytes, two neighbours that make
    a token have always been a rule's: the rules would have made that token from them.
    """
    j = json.loads(spec)
    m, pre = j["model"], j["pre_tokenizer"] or {}
    if m["type"] != "BPE" or j["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) \
            or m["dropout"] or m["continuing_subword_prefix"] or m["end_of_word_suffix"] or m["ignore_merges"]:
        return False
    merges = [tuple(x) if isinstance(x, list) else tuple(x.split(" ")) for x in m["merges"]]
    at = [m["vocab"][x + y] for x, y in merges]
    if at != sorted(set(at)):
        return False
    rank = {x: i for i, x in enumerate(merges)}
    for x, y in merges:
        parts = list(x + y)
        while len(parts) > 1:
            k = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), len(rank)))
            if (parts[k], parts[k + 1]) not in rank:
                return False
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
    return True


class TokenPair:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, spec_a: bytes, spec_b: bytes, alike: bool | None = None):
        """``alike``: what ``merges_alike`` says of A's file, if it is known already."""
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_buffer(spec_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = SentencePieceProcessor(model_proto=spec_b)
        code = byte_of_symbol()
        n_a = max(self.a.get_vocab(True).values(), default=-1) + 1
        self.bytes_a = [b""] * n_a
        special = {i: t.content for i, t in self.a.get_added_tokens_decoder().items()}
        for token, i in self.a.get_vocab(True).items():
            self.bytes_a[i] = special[i].encode() if i in special else bytes(code[c] for c in token)
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.sizes_a, self.sizes_b = self.size_a.tolist(), self.size_b.tolist()
        self.spaced_a, self.spaced_b = (np.array([x[:1] == b" " for x in y]) for y in (self.bytes_a, self.bytes_b))
        # ids as they are written inside and at the end of their side of a group
        self.written_a = [f"{i}," for i in range(n_a)], [f"{i}|" for i in range(n_a)]
        self.written_b = [f"{i}," for i in range(len(self.bytes_b))], [f"{i};" for i in range(len(self.bytes_b))]
        self.windows: dict[bytes, tuple] = {}
        self.fast = self._tiktoken(json.loads(spec_a)) if (merges_alike(spec_a) if alike is None else alike) else None

    def _tiktoken(self, j: dict):
        import tiktoken
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {self.bytes_a[i]: i for t, i in j["model"]["vocab"].items() if t not in special}
        return tiktoken.Encoding("pair", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def _piece(self, i: int) -> bytes:
        p = self.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()

    def tokens(self, texts: list[str | None]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of both tokenizers for each text, None without tokens."""
        out: list = [None] * len(texts)
        some = [k for k, t in enumerate(texts) if t]
        slow = [k for k in some if self.fast is None or UNSETTLED.search(texts[k])]
        ids = dict(zip(slow, (e.ids for e in self.a.encode_batch_fast([" " + texts[k] for k in slow], add_special_tokens=False)), strict=True))
        size_a, of_b = self.sizes_a.__getitem__, self.bytes_b.__getitem__
        for k, y in zip(some, self.b.encode([texts[k] for k in some], num_threads=1), strict=True):
            s = " " + texts[k]
            x = ids[k] if k in ids else self.fast.encode_ordinary(s)
            raw = s.encode()
            # byte-level tokens stand for the bytes they cover, so A's need only cover them all
            if b"".join(map(of_b, y)) == raw and sum(map(size_a, x)) == len(raw):
                out[k] = x, y
        return out

    def align(self, keys: list[bytes]) -> list[tuple[str, int, bytes]]:
        """(groups as text, number of groups, link codes) of windows, each the ids of A and then those of B, marked by ``OF_B``."""
        if not keys:
            return []
        flat, sizes = np.frombuffer(b"".join(keys), "<i4").astype(np.int64), np.array([len(k) >> 2 for k in keys])
        of_b = flat >= OF_B
        a, b = flat[~of_b], flat[of_b] - OF_B
        n_b = np.add.reduceat(of_b.astype(np.int64), np.cumsum(sizes) - sizes)
        n_a = sizes - n_b
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        # bytes between neighbouring ends belong to one token of each: a link
        seams = np.union1d(ends_a, ends_b)
        codes = a[np.searchsorted(ends_a, seams)] << B_BITS | b[np.searchsorted(ends_b, seams)]
        last_a = ends_b[np.searchsorted(ends_b, ends_a)] == ends_a
        last_b = ends_a[np.searchsorted(ends_a, ends_b)] == ends_b
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        order = np.argsort(np.concatenate((2 * group_a, 2 * group_b + 1)), kind="stable")
        (comma, bar), (also, over) = self.written_a, self.written_b
        pieces = [bar[x] if e else comma[x] for x, e in zip(a.tolist(), last_a.tolist(), strict=True)]
        pieces += [over[x] if e else also[x] for x, e in zip(b.tolist(), last_b.tolist(), strict=True)]
        pieces = list(map(pieces.__getitem__, order.tolist()))
        at, groups = np.cumsum(sizes).tolist(), np.diff(group_a[np.cumsum(n_a) - 1] + 1, prepend=0).tolist()
        links, raw = (8 * (np.searchsorted(seams, ends_a[np.cumsum(n_a) - 1]) + 1)).tolist(), codes.astype("<i8").tobytes()
        return [("".join(pieces[p:q])[:-1], n, raw[r:s]) for p, q, n, r, s in zip([0, *at], at, groups, [0, *links], links, strict=False)]

    def cuts(self, a: np.ndarray, b: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where windows end, in tokens of A and of B: shared ends before space-marked tokens.

        ``a`` and ``b`` are the tokens of documents put together, ``ends`` the bytes where these end.
        """
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        at = np.searchsorted(ends_b, ends_a)
        i = np.flatnonzero(ends_b[at] == ends_a)
        j = at[i]
        spaced = np.ones(len(i), bool)
        spaced[:-1] = self.spaced_a[a[i[:-1] + 1]] & self.spaced_b[b[j[:-1] + 1]]
        keep = spaced | np.isin(ends_a[i], ends)
        return i[keep] + 1, j[keep] + 1


def _mixed(ids: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each stretch of ids that ends at ``ends``."""
    starts = np.concatenate(([0], ends[:-1]))
    place = np.arange(len(ids)) - np.repeat(starts, ends - starts)
    h = (ids.astype(np.uint64) + np.uint64(seed) + (place.astype(np.uint64) << np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.add.reduceat(h ^ h >> np.uint64(32), starts) if len(ends) else np.zeros(0, np.uint64)


def _alike(ids: np.ndarray, ends: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each stretch has the ids of stretch ``of``."""
    sizes = np.diff(ends, prepend=0)
    starts, same = ends - sizes, sizes == sizes[of]
    take = np.where(same, sizes, 0)
    first = np.cumsum(take) - take
    place = np.arange(take.sum()) - np.repeat(first, take)
    equal = ids[np.repeat(starts, take) + place] == ids[np.repeat(starts[of], take) + place]
    wrong = np.concatenate(([0], np.cumsum(~equal)))
    return same & (wrong[first + take] == wrong[first])


def loaded(spec_a, spec_b, alike: bool) -> TokenPair:
    """The worker's own pair of tokenizers, made once per broadcast."""
    if _LOADED.get("of") != (spec_a, spec_b):
        _LOADED.update(of=(spec_a, spec_b), pair=TokenPair(spec_a.value, spec_b.value, alike))
    return _LOADED["pair"]


class Block:
    """Windows of the documents of one block, numbered as they come."""

    def __init__(self, pair: TokenPair, no: int):
        self.pair, self.no = pair, no
        self.numbers: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.groups: list[int] = []
        self.links: list[bytes] = []
        self.refs: list[np.ndarray] = []
        self.tokens = 0

    def full(self) -> bool:
        return self.tokens >= BLOCK_TOKENS or len(self.links) >= BLOCK_WINDOWS

    def documents(self, some: list[tuple[list[int], list[int]]]) -> list[tuple[str, bytes]]:
        """(digest of the groups, numbers of the windows) of documents."""
        if not some:
            return []
        a, b = (np.fromiter(chain.from_iterable(x[k] for x in some), np.int64, sum(len(x[k]) for x in some)) for k in (0, 1))
        size = np.cumsum([len(x[0]) for x in some])
        bytes_at = np.cumsum(self.pair.size_a[a])[size - 1]
        i, j = self.pair.cuts(a, b, bytes_at)
        # equal hashes are compared with their first window, and are windows of their own if that differs
        h = _mixed(a, i, 1) ^ (_mixed(b, j, 2) * np.uint64(0x94D049BB133111EB))
        _, first, at = np.unique(h, return_index=True, return_inverse=True)
        of = first[at]
        of = np.where(_alike(a, i, of) & _alike(b, j, of), of, np.arange(len(of)))
        numbers = np.zeros(len(of), np.int64)
        i0, j0 = np.concatenate(([0], i[:-1])), np.concatenate(([0], j[:-1]))
        own = np.flatnonzero(of == np.arange(len(of)))
        x, y = a.astype("<i4").tobytes(), (b + OF_B).astype("<i4").tobytes()
        keys = [x[p:q] + y[r:s] for p, q, r, s in zip(*((4 * v[own]).tolist() for v in (i0, i, j0, j)), strict=True)]
        found = list(map(self.numbers.get, keys))
        if None in found:
            self.add(list(dict.fromkeys(k for k, n in zip(keys, found, strict=True) if n is None)))
            found = list(map(self.numbers.__getitem__, keys))
        numbers[own] = found
        refs = numbers[of].astype("<i4")
        self.tokens += len(a)
        self.refs.append(refs)
        text, out, s = self.texts.__getitem__, [], 0
        for e in (np.searchsorted(i, size) + 1).tolist():
            out.append((hashlib.sha256(";".join(map(text, refs[s:e].tolist())).encode()).hexdigest(), refs[s:e].tobytes()))
            s = e
        return out

    def add(self, keys: list[bytes]) -> None:
        """Number windows that the block doesn't hold yet."""
        known = self.pair.windows
        todo = [k for k in keys if k not in known]
        if len(known) + len(todo) > MAX_WINDOWS:
            known.clear()
            todo = keys
        long = {}
        for k, w in zip(todo, self.pair.align(todo), strict=True):
            (known if len(k) <= LONGEST else long)[k] = w
        for k in keys:
            w = known.get(k) or long[k]
            self.numbers[k] = len(self.links)
            self.texts.append(w[0])
            self.groups.append(w[1])
            self.links.append(w[2])

    def pairs(self) -> tuple[bytes, bytes, bytes, np.ndarray, np.ndarray]:
        """(groups of each window, links of each window, number of the pair of each link, pairs, count of each pair)."""
        sizes = np.array([len(x) >> 3 for x in self.links], "<i4")
        uses = np.bincount(np.concatenate(self.refs), minlength=len(sizes)) if self.refs else np.zeros(0, np.int64)
        codes, at = np.unique(np.frombuffer(b"".join(self.links), "<i8"), return_inverse=True)
        n = np.zeros(len(codes), np.int64)
        np.add.at(n, at, np.repeat(uses, sizes))
        return np.array(self.groups, "<i4").tobytes(), sizes.tobytes(), at.astype("<i4").tobytes(), codes, n


_ROW = "block long, doc_id {t}, n_a long, n_b long, groups_sha256 string, refs binary, groups binary, sizes binary, at binary, codes array<long>, counts array<long>"
_OUT = "doc_id {t}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@cache
def _codecs() -> tuple:
    import zstandard
    return zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _packed(raw: bytes) -> bytes:
    return _codecs()[0].compress(raw)


def _plain(raw: bytes) -> np.ndarray:
    return np.frombuffer(_codecs()[1].decompress(raw), "<i4")


def _aligner(spec_a, spec_b, alike: bool, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, no = loaded(spec_a, spec_b, alike), TaskContext.get().partitionId() << 24
        block = Block(pair, no)

        def closed() -> pa.RecordBatch:
            groups, sizes, at, codes, n = block.pairs()
            cols = {"block": pa.array([block.no], pa.int64()), "groups": pa.array([_packed(groups)]), "sizes": pa.array([_packed(sizes)]), "at": pa.array([_packed(at)]),
                    "codes": pa.ListArray.from_arrays([0, len(codes)], codes), "counts": pa.ListArray.from_arrays([0, len(n)], n)}
            return pa.record_batch([cols[f.name].cast(f.type) if f.name in cols else pa.nulls(1, f.type) for f in schema], schema=schema)

        for b in batches:
            for s, e in stretches(pa.compute.utf8_length(b.column(1)).fill_null(0).to_pylist()):
                some = pair.tokens(b.column(1).slice(s, e - s).to_pylist())
                found = iter(block.documents([t for t in some if t]))
                out = []
                for i, t in zip(b.column(0).slice(s, e - s).to_pylist(), some, strict=True):
                    sha, refs = next(found) if t else ("", b"")
                    out.append({"block": block.no, "doc_id": i, "n_a": len(t[0]) if t else 0, "n_b": len(t[1]) if t else 0,
                                "groups_sha256": sha, "refs": _packed(refs) if t else b""})
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                if block.full():
                    yield closed()
                    no += 1
                    block = Block(pair, no)
        yield closed()
    return run


def stretches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """(from, to) of rows that are worked off together."""
    a = held = 0
    for k, n in enumerate(sizes):
        held += n
        if held >= CHARACTERS or k + 1 - a >= TEXTS:
            yield a, k + 1
            a, held = k + 1, 0
    if a < len(sizes):
        yield a, len(sizes)


def _counted(schema: pa.Schema):
    """Documents and links of a block meet the counts of its pairs."""
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        doc = pa.compute.is_valid(rows["refs"])
        docs, own = rows.filter(doc), rows.filter(pa.compute.invert(doc))
        # per window: groups, links, links that are best, counts of the links
        by_window = np.zeros((4, 0), np.int64)
        if replies.num_rows:
            total, top = np.zeros(replies.num_rows, np.int64), np.zeros(replies.num_rows, np.int64)
            i = replies["i"].to_numpy()
            total[i], top[i] = replies["total"].to_numpy(), replies["best"].to_numpy()
            groups, sizes, at = (_plain(own[c][0].as_py()) for c in ("groups", "sizes", "at"))
            heads = np.cumsum(sizes) - sizes
            by_window = np.stack((groups, sizes, np.add.reduceat(top[at], heads), np.add.reduceat(total[at], heads)))
        refs = [_plain(r) if r else np.zeros(0, np.int32) for r in docs["refs"].to_pylist()]
        sums = np.array([by_window[:, w].sum(axis=1) for w in refs], np.int64).reshape(len(refs), 4)
        cols = {c: docs[c] for c in ("doc_id", "n_a", "n_b", "groups_sha256")}
        cols |= {c: pa.array(sums[:, k], pa.int64()) for k, c in enumerate(("n_groups", "n_links", "n_best", "count_sum"))}
        return pa.table({f.name: cols[f.name] for f in schema}).cast(schema)
    return run


def align_documents(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    The tokenizers are files that the driver reads: a byte-level BPE of the
    tokenizers library and a sentencepiece model.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    spark = docs.sparkSession
    specs = []
    for path in (tokenizer_a, tokenizer_b):
        with open(path, "rb") as f:
            specs.append(spark.sparkContext.broadcast(f.read()))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    row, out = (to_arrow_schema(StructType.fromDDL(s.format(t=kind))) for s in (_ROW, _OUT))
    aligned = stage(src.mapInArrow(_aligner(*specs, merges_alike(specs[0].value), row), _ROW.format(t=kind)), "aligned")
    pairs = stage(aligned.where("codes is not null").select("block", F.posexplode(F.arrays_zip("codes", "counts")).alias("i", "p"))
                  .select("block", F.col("i").cast("int").alias("i"), F.col("p.codes").alias("code"), F.col("p.counts").alias("n")), "pairs")
    # an id of B has no more pairs than A has ids
    of_b = Window.partitionBy(F.col("code").bitwiseAND((1 << B_BITS) - 1))
    totals = pairs.groupBy("code").agg(F.sum("n").alias("total")).withColumn("best", (F.col("total") == F.max("total").over(of_b)).cast("int"))
    replies = pairs.select("block", "i", "code").join(totals, "code").select("block", "i", "total", "best")
    mine = aligned.select("block", "doc_id", "n_a", "n_b", "groups_sha256", "refs", "groups", "sizes", "at")
    done = mine.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_counted(out), _OUT.format(t=kind))
    return done.withColumnRenamed("doc_id", id_col)
