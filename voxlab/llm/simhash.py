"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at ``distance`` or fewer bits have a value in common among
the variants of each within half that distance.  Every distinct fingerprint
emits all its variants, equal variants meet, and what meets is verified.

2,081 variants of 64 bits a fingerprint would make the shuffle many times
the input.  So the shuffle is on the leading part of a variant, and only that part
of the ball is spread before it: with k key bits, a fingerprint is sent once
for each way to flip at most two of them (1 + k + k(k-1)/2 rows); the flips
left over are spread where it arrives, as all variants with that key meet
there anyway.  A key's variants are divided bit by bit in the same way where they are
more than a task holds at a time, so k stays small: it grows only where a key's
fingerprints themselves would be too many.

Members of one variant lie within ``distance`` of each other by the triangle
inequality, so the links kept from it lead to its least member.  An odd distance
takes the next radius: two fingerprints at it meet where one of them flips a bit less,
so there the links lead to a member with the fewest flips, which all others of that
variant that are near enough for it lie around.  Links are
verified by their bits and thinned to a spanning forest per key before they leave
the task.  No step emits all pairs of a group.

Defined results: a null or wordless text has fingerprint zero and links like
any other; fewer words than a shingle are one shingle; rows without an id
take part, and component_id is the least id present (null if there is none);
repeated rows stay repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components

SEED = 42
#: Variants held at a time by one task.
HELD = 1 << 19
#: Key bits that give all tasks their share, and fingerprints of a key beyond which more bits are taken.
KEY_BITS, MAX_KEY_BITS, GROUP = 7, 24, 1 << 20
#: Balls beyond half this distance (679,121 variants) aren't spread.
MAX_DISTANCE = 8
#: Parts that a component's fingerprints are dealt in where they meet its least id.
PARTS = 32


def fingerprint(text: str | None, words: int = 4, step: int = 1 << 19) -> int:
    """64-bit SimHash over word shingles, repeats included."""
    import xxhash
    found = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not found:
        return 0
    joined, size = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found)) + 1
    n = max(1, len(found) - words + 1)
    starts = np.concatenate(([0], np.cumsum(size)))
    ends = starts[min(words, len(found)):] - 1
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, n, step):
        h = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[a:min(a + step, n)].tolist(), ends[a:a + step].tolist())], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (signed long), row_hash of the text."""
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.col(text_col)).alias("row_hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64()), b.column(2)], names=["doc_id", "fp", "row_hash"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, fp long, row_hash long")


@cache
def _ball(free: tuple[int, ...], radius: int) -> np.ndarray:
    """Masks that flip at most ``radius`` of the free bits."""
    return np.array([sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(free, r)], dtype=np.uint64)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least connected node of each of n nodes under links (a, b)."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def _meetings(base: np.ndarray, left: np.ndarray, owner: np.ndarray, free: tuple[int, ...], odd: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (owner, owner) of equal variants; ``left`` is how many free bits each base may still flip.

    They lead to the variant's least owner, or with ``odd`` to its least one of those with the fewest flips.
    """
    sizes = [len(_ball(free, r)) for r in range(int(left.max(initial=0)) + 1)]
    total = sum(int((left == r).sum()) * s for r, s in enumerate(sizes))
    if len(base) < 2:
        return
    if total > HELD and free:
        bit, rest = np.uint64(1 << free[0]), free[1:]
        for side in (np.uint64(0), bit):
            same = (base & bit) == side
            keep = same | (left > 0)
            yield from _meetings(np.where(same, base, base ^ bit)[keep], np.where(same, left, left - 1)[keep], owner[keep], rest, odd)
        return
    parts, owners, spare = [], [], []
    for r in range(len(sizes)):
        own = np.flatnonzero(left == r)
        if len(own):
            ball = _ball(free, r)
            parts.append((base[own][:, None] ^ ball[None, :]).ravel())
            owners.append(np.repeat(owner[own], len(ball)))
            if odd:
                spare.append(np.tile(r - np.bitwise_count(ball).astype(np.int8), len(own)))
    v, who = np.concatenate(parts), np.concatenate(owners)
    s = np.sort(v)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return
    # only members of variants that occur more than once are ordered; a small table leaves out most others
    table = np.zeros(1 << 16, bool)
    spread = np.uint64(0x9E3779B97F4A7C15)
    table[(twice * spread) >> np.uint64(48)] = True
    some = np.flatnonzero(table[(v * spread) >> np.uint64(48)])
    some = some[np.isin(v[some], twice)]
    some = some[np.lexsort((who[some], -np.concatenate(spare)[some], v[some]) if odd else (who[some], v[some]))]
    first = np.concatenate(([True], v[some][1:] != v[some][:-1]))
    yield who[some], who[some][np.flatnonzero(first)][np.cumsum(first) - 1]


def _linker(distance: int, bits: list[int], free: tuple[int, ...]):
    radius, keyed = (distance + 1) // 2, np.uint64(sum(1 << i for i in bits))

    def run(key: tuple, t: pa.Table) -> pa.Table:
        fp = np.sort(t["fp"].to_numpy()).view(np.uint64)
        base = fp & ~keyed | np.uint64(key[0].as_py() % (1 << 64))
        flips = np.bitwise_count(base ^ fp).astype(np.int64)
        n, root = len(fp), np.arange(len(fp))
        for a, b in _meetings(base, radius - flips, np.arange(n), free, distance % 2 == 1):
            near = np.bitwise_count(fp[a] ^ fp[b]) <= distance
            a, b = a[near], b[near]
            root = _roots(np.concatenate((a, np.arange(n))), np.concatenate((b, root)), n)
        out = np.flatnonzero(root != np.arange(n))
        return pa.table({"a": fp[out].view(np.int64), "b": fp[root[out]].view(np.int64)})
    return run


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) whose components are those of the fingerprints at ``distance`` or fewer bits."""
    if not 0 <= distance <= MAX_DISTANCE:
        raise ValueError(f"distance {distance} is not from 0 to {MAX_DISTANCE}")
    n, radius = distinct.count(), (distance + 1) // 2
    per = sum(comb(64, r) for r in range(radius + 1))
    k = min(KEY_BITS, max(0, int(np.ceil(np.log2(max(1, n * per / HELD))))) + 1)
    while k < MAX_KEY_BITS and n * sum(comb(k, r) for r in range(radius + 1)) >> k > GROUP:
        k += 1
    # key bits: those that split the fingerprints most evenly; a key's variants are divided by the next ones
    ones = distinct.agg(*[F.coalesce(F.sum(F.shiftrightunsigned("fp", i).bitwiseAND(1)), F.lit(0)).alias(f"b{i}") for i in range(64)]).first()
    even = sorted(range(64), key=lambda i: abs(2 * ones[i] - n))
    bits = sorted(even[:k])
    keyed = sum(1 << i for i in bits)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    flips = F.array(*[F.lit(signed(int(m))).cast("long") for m in _ball(tuple(bits), radius)])
    # outside the key a flipped fingerprint is the fingerprint, so the key and that are all that is sent
    sent = distinct.select("fp", F.explode(flips).alias("_m")) \
        .select("fp", F.col("fp").bitwiseXOR(F.col("_m")).bitwiseAND(F.lit(signed(keyed)).cast("long")).alias("key"))
    return sent.groupBy("key").applyInArrow(_linker(distance, bits, tuple(even[k:])), "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, fp, row_hash, root (least fingerprint of the component, signed), component_id."""
    rows = stage(fingerprints(docs, words, id_col, text_col), "fingerprints")
    distinct = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct")
    linked = components(links(distinct.select("fp"), distance))
    named = stage(distinct.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "least_id", "root"), "named")
    # a component may hold a large share of all fingerprints, so they meet its least id in parts
    some = named.where("root is not null")
    shared = some.groupBy("root").agg(F.min("least_id").alias("component_id")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    grouped = some.withColumn("_part", F.pmod(F.xxhash64("fp"), F.lit(PARTS)).cast("int")).join(shared, ["root", "_part"])
    alone = named.where("root is null").select(F.col("fp").alias("_fp"), F.col("fp").alias("root"), F.col("least_id").alias("component_id"))
    classes = stage(alone.unionByName(grouped.select(F.col("fp").alias("_fp"), "root", "component_id")), "classes")
    return rows.join(classes, F.col("fp") == F.col("_fp")).select(F.col("doc_id").alias(id_col), "fp", "row_hash", "root", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame, words: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with one document of each group: that with the least id.

    Of a group's rows that repeat that id the one whose text has the least hash
    stays; a group without any id keeps the row with the least hash.
    """
    rows = stage(near_duplicates(docs, words, distance, id_col, text_col), "groups")
    named = rows.where(F.col(id_col) == F.col("component_id")).groupBy(F.col(id_col).alias("_id"), "root") \
        .agg(F.min("row_hash").alias("_h")).select("_id", "_h")
    unnamed = rows.where("component_id is null").groupBy("root").agg(F.min("row_hash").alias("_h")) \
        .select(F.lit(None).cast(named.schema["_id"].dataType).alias("_id"), "_h")
    # a struct is never null, so rows without an id meet by it too, and one shuffle of the texts serves the join and the repeats
    kept = stage(named.unionByName(unnamed).distinct().select(F.struct("_id", "_h").alias("_row")), "kept")
    cols = docs.columns
    d = docs.toDF(*[f"c{i}" for i in range(len(cols))])
    own, text = F.col(f"c{cols.index(id_col)}"), F.col(f"c{cols.index(text_col)}")
    d = d.withColumn("_row", F.struct(own.alias("_id"), F.xxhash64(text).alias("_h")).cast(kept.schema["_row"].dataType))
    return d.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).drop("_row").toDF(*cols)
