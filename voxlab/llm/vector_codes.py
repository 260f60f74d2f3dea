"""Vector code compression: product codes fitted over a lexicographic trie of distinct parts.

Vectors are turned into integers and cut into equal consecutive parts.  Equal
parts are counted once, with their number as weight, and kept in lexicographic
order, which is the order in which a depth-first traversal of their trie meets
its leaves.  A task walks its stretch of leaves a block at a time: a prefix that
several parts share has one vector of distances to all codebook entries,
accumulated dimension by dimension from that of the prefix before it, and
where a part leaves its last neighbour the rest of its path is one edge,
added in one matrix product.  A leaf takes the nearest entry and adds its
weight times itself to that entry's sums.

Only the codebooks and their sums pass through the driver: parts x entries x
dimensions numbers, whatever the number of vectors.  Parts are dealt out by
ranges of their order, so neither equal vectors nor equal prefixes gather in
a task.  The last assignment walks the rows themselves, block by block, and needs
no join back.

Defined results: vectors null or holding null or non-finite components are
dropped; vectors shorter than the longest, and all if the parts would be
unequal, are filled up with zeros; rows that share an id are rows of their
own, in the order of their components where the first codebook is taken; an id
of null comes after all others there; with fewer rows than entries the codebook has as
many entries as rows; ties go to the lower entry; labels of null are equal to one another;
an empty table gives an empty result.  Components of 2^40 and more (after scaling), whose
squared distances leave the range of a long, raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

BLOCK = 4096
#: Keys under which the rows of one label meet their sum.
DEALT = 32
LIMIT = 1 << 40
#: Below this, distances are exact in double precision.
EXACT = 1 << 53


@dataclass
class Shape:
    """Parts, dimensions of a part, entries of a codebook and bytes of a component."""
    parts: int
    dims: int
    entries: int
    width: int


def pack(x: np.ndarray, width: int) -> np.ndarray:
    """Rows of integers as bytes whose order is the lexicographic order of the rows."""
    bias = 1 << (8 * width - 1)
    wide = (x.astype(np.int64).view(np.uint64) + np.uint64(bias)) if width == 8 else (x.astype(np.int64) + bias)
    return np.ascontiguousarray(wide.astype(f">u{width}")).view(f"S{width * x.shape[1]}").ravel() if x.shape[1] else np.zeros(len(x), "S1")


def unpack(raw: bytes, n: int, shape: Shape) -> np.ndarray:
    """The rows of ``pack`` again, as long."""
    wide = np.frombuffer(raw, f">u{shape.width}").reshape(n, shape.dims).astype(np.uint64)
    return (wide - np.uint64(1 << (8 * shape.width - 1))).view(np.int64) if shape.width == 8 else wide.astype(np.int64) - (1 << 31)


def _edge(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (rows, entries) over the dimensions given."""
    if x.dtype == object:
        return ((x[:, None, :] - c[None, :, :]) ** 2).sum(axis=2)
    return (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]


def nearest(x: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of sorted distinct rows: the trie over one block of leaves."""
    n, dims = x.shape
    if not n or not dims:
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    reach = int(max(abs(int(x.min())), abs(int(x.max())))) + int(max(abs(int(codebook.min())), abs(int(codebook.max()))))
    kind = np.float64 if 4 * reach * reach * dims < EXACT else object
    v, c = x.astype(kind), codebook.astype(kind)
    # shared[i]: dimensions that row i has in common with a neighbour; from there its path is its own
    same = np.cumprod(x[1:] == x[:-1], axis=1).sum(axis=1) if n > 1 else np.zeros(0, np.int64)
    shared = np.maximum(np.concatenate(([0], same)), np.concatenate((same, [0])))
    best, far = np.zeros(n, np.int64), np.zeros(n, object if kind is object else np.int64)
    rows = np.arange(n)  # leaves below the prefixes of this depth that several parts share
    node = np.zeros(n, np.int64)
    acc = np.zeros((1, len(c)), kind)
    for d in range(dims):
        ends = shared[rows] <= d
        if ends.any():
            leaf = rows[ends]
            dist = acc[node[ends]] + _edge(v[leaf, d:], c[:, d:])
            k = dist.argmin(axis=1)
            best[leaf], far[leaf] = k, dist[np.arange(len(leaf)), k]
        rows, node = rows[~ends], node[~ends]
        if not len(rows):
            break
        # a new prefix begins where the leaf shares at most d dimensions with the leaf before it
        first = np.concatenate(([True], (same[rows[1:] - 1] <= d) | (rows[1:] != rows[:-1] + 1)))
        begin = np.flatnonzero(first)
        acc = acc[node[begin]] + (v[rows[begin], d][:, None] - c[:, d][None, :]) ** 2
        node = np.cumsum(first) - 1
    return best, far


def integers(vec: Column, scale: int) -> Column:
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale))


def _parts(rows: DataFrame, shape: Shape) -> DataFrame:
    """(part, bytes) of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                x = _matrix(b.column(0).slice(a, BLOCK), shape)
                for p in range(shape.parts):
                    got, counts = np.unique(pack(x[:, p * shape.dims:(p + 1) * shape.dims], shape.width), return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(got), p), pa.int32()), _fixed(got, shape), pa.array(counts, pa.int64())],
                                          names=["part", "bytes", "n"])
    return rows.select("v").mapInArrow(run, "part int, bytes binary, n long")


def _fixed(packed: np.ndarray, shape: Shape) -> pa.Array:
    size = shape.width * shape.dims
    return pa.array([packed[i:i + 1].tobytes() for i in range(len(packed))] if size else [b""] * len(packed), pa.binary())


def _matrix(v: pa.Array, shape: Shape) -> np.ndarray:
    """Integer rows, filled up with zeros."""
    dims = shape.parts * shape.dims
    sizes = np.diff(v.offsets.to_numpy())
    flat = v.flatten().to_numpy(zero_copy_only=False)
    if len(v) and (sizes == dims).all():
        return flat.reshape(len(v), dims).astype(np.int64)
    out = np.zeros((len(v), dims), np.int64)
    out[np.arange(dims)[None, :] < sizes[:, None]] = flat
    return out


def _assigned(distinct: DataFrame, books: list[np.ndarray], shape: Shape) -> list[np.ndarray]:
    """One round: every distinct part to its nearest entry, every entry to the floor of its parts' mean."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((shape.entries, shape.dims + 1), object) for _ in range(shape.parts)]
        for b in batches:
            part, raw, n = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy()
            for p in np.unique(part).tolist():
                own = np.flatnonzero(part == p)
                for a in range(0, len(own), BLOCK):
                    some = own[a:a + BLOCK]
                    x = unpack(b"".join(raw.take(pa.array(some)).to_pylist()), len(some), shape)
                    k, _ = nearest(x, books[p])
                    w = np.concatenate((x, np.ones((len(x), 1), np.int64)), axis=1)
                    top = int(max(abs(int(w.max())), abs(int(w.min())))) * int(n[some].sum())
                    w = w * n[some][:, None] if top < 1 << 62 else w.astype(object) * n[some].astype(object)[:, None]
                    order = np.argsort(k, kind="stable")
                    heads = np.flatnonzero(np.diff(k[order], prepend=-1))
                    sums[p][k[order][heads]] += np.add.reduceat(w[order], heads, axis=0).astype(object)
        for p in range(shape.parts):
            e = np.flatnonzero(sums[p][:, -1] != 0)
            s = sums[p][e].ravel()
            yield pa.record_batch([pa.array(np.full(len(s), p), pa.int32()), pa.array(np.repeat(e, shape.dims + 1), pa.int32()),
                                   pa.array(np.tile(np.arange(shape.dims + 1), len(e)), pa.int32()),
                                   pa.array([i >> 32 for i in s], pa.int64()), pa.array([i & 0xFFFFFFFF for i in s], pa.int64())],
                                  names=["part", "entry", "j", "high", "low"])

    sums = distinct.select("part", "bytes", "n").mapInArrow(run, "part int, entry int, j int, high long, low long") \
        .groupBy("part", "entry", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    total: dict = {}
    for r in sums.collect():  # at most parts x entries x (dims + 1) rows
        total[r["part"], r["entry"], r["j"]] = (r["high"] << 32) + r["low"]
    out = [b.copy() for b in books]
    for (p, e, j), s in total.items():
        if j < shape.dims:
            out[p][e, j] = s // total[p, e, shape.dims]
    return out


def _coded(rows: DataFrame, books: list[np.ndarray], shape: Shape) -> DataFrame:
    """Code and error of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                s = b.slice(a, BLOCK)
                x = _matrix(s.column(2), shape)
                codes, error = np.zeros((len(x), shape.parts), np.int64), np.zeros(len(x), object)
                for p in range(shape.parts):
                    part = x[:, p * shape.dims:(p + 1) * shape.dims]
                    _, first, at = np.unique(pack(part, shape.width), return_index=True, return_inverse=True)
                    k, far = nearest(part[first], books[p])
                    codes[:, p] = k[at]
                    error += far[at].astype(object)
                if len(x) and max(error) >= 1 << 63:
                    raise ArithmeticError("a squared distance leaves the range of a long")
                text = ["".join(f"{i:02x}" for i in r) for r in codes.tolist()]
                yield pa.record_batch([s.column(0), s.column(1), pa.array(text, pa.string()), pa.array(error.tolist(), pa.int64())],
                                      names=["vec_id", "label", "code", "error"])

    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return rows.select("vec_id", "label", "v").mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def codebook_digest(books: list[np.ndarray]) -> str:
    flat = ",".join(str(int(i)) for b in books for i in b.ravel())
    return hashlib.sha256(flat.encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
             scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows of id, code, error, label_error, codebooks_sha256; the codebooks).

    Codes give the entry of each part in two hex digits, so ``entries`` is at most 256.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits a part: 1 to 256 entries")
    number = lambda x: x.cast("double")
    unsound = F.exists("e", lambda x: x.isNull() | F.isnan(number(x)) | (F.abs(number(x)) == float("inf")))
    kept = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vec_col).alias("e")).where(F.col("e").isNotNull() & ~unsound)
    if not kept.where(F.exists("e", lambda x: F.abs(x.cast("double")) * scale >= float(LIMIT))).isEmpty():
        raise ArithmeticError("a component leaves the range whose squared distances fit a long")
    rows = stage(kept.select("vec_id", "label", integers(F.col("e"), scale).alias("v")), "vectors")
    seen = rows.agg(F.max(F.size("v")).alias("size"), F.max(F.greatest(F.coalesce(F.array_max("v"), F.lit(0)), -F.coalesce(F.array_min("v"), F.lit(0)))).alias("top")).first()
    dims = -(-(seen["size"] or 0) // parts)
    heads = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").toPandas()["v"]
    first = np.zeros((len(heads), parts * dims), np.int64)
    for i, v in enumerate(heads):
        first[i, :len(v)] = v
    shape = Shape(parts, dims, len(heads), 4 if (seen["top"] or 0) < 1 << 31 else 8)
    books = [first[:, p * dims:(p + 1) * dims] for p in range(parts)]
    if len(heads):
        distinct = _parts(rows, shape).groupBy("part", "bytes").agg(F.sum("n").alias("n"))
        distinct = stage(distinct.repartitionByRange("part", "bytes").sortWithinPartitions("part", "bytes"), "parts")
        for _ in range(rounds):
            books = _assigned(distinct, books, shape)
    out = stage(_coded(rows, books, shape), "codes")
    # a label may hold a large share of all rows, which meet its sum in parts
    dealt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(DEALT)).cast("int")
    sums = out.groupBy("label").agg(F.sum("error").alias("label_error")) \
        .select(F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("_part"))
    met = out.withColumn("_part", dealt).join(sums.withColumnRenamed("_part", "_to"), F.col("label").eqNullSafe(F.col("_label")) & (F.col("_part") == F.col("_to")))
    return met.select(F.col("vec_id").alias(id_col), "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256")), books
