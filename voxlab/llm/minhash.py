"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's set of word shingles has a signature of ``COORDINATES`` minima.
Equal sets are one node.  Nodes are posted under each pair of coordinate and value.

* Prefix: two nodes that agree in at least ``MATCHES`` coordinates share one of the
  rarest ``COORDINATES - MATCHES + 1`` pairs of either, rarity being one order over
  all pairs, so a node is posted under those alone.  Pairs that occur once are the
  rarest and are posted nowhere; a node with fewer than ``MATCHES`` others is done with.
  Values that very many nodes have come last in the order, so boilerplate
  makes no long lists.
* Skip: where a list is merged, collisions are counted only for nodes whose sizes allow
  the similarity and that no link found so far has joined.
* Pairs above the match threshold make clusters of candidates; within a cluster
  links are confirmed on the full sets.

Both merges (of lists by collisions, of clusters by full sets) go the same way. A
group is dealt into chunks; each is joined in one task; then a member that is not
in the group's largest class so far meets the other chunks.  So a pair is either compared or
already joined, a group of thousands of near copies costs about its size, and no
task holds more than two chunks.

A pair at the threshold is overlooked when fewer than ``MATCHES`` coordinates agree:
``overlooked`` gives the probability, 1.4e-8 for the defaults at 0.85 and less above.

Defined results: a text with fewer words than a shingle is one shingle; null, empty and
wordless texts have no shingles and link with nothing; rows without an id take part,
component_id is the least id present (null if there is none) and such a row is kept only
in a component without ids; repeated rows stay repeated, each in the component of its
set; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .components import components

COORDINATES, MATCHES = 48, 25
SEED = 42
#: Members of a group that one task compares with one another.
LIST_CHUNK, CLUSTER_CHUNK = 1024, 256
#: Shingles hashed at a time.
STEP = 1 << 17
#: Words that a worker remembers.
MAX_WORDS = 500_000

_WORDS: dict[bytes, int] = {}


def overlooked(similarity: float, coordinates: int = COORDINATES, matches: int = MATCHES) -> float:
    """Probability that two sets of this similarity agree in fewer than ``matches`` coordinates."""
    return sum(math.comb(coordinates, i) * similarity ** i * (1 - similarity) ** (coordinates - i) for i in range(matches))


def _odd_numbers(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text."""
    import xxhash
    found = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not found:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > MAX_WORDS:
        _WORDS.clear()
    get, hashes = _WORDS.get, []
    for w in found:
        h = get(w)
        if h is None:
            h = xxhash.xxh64_intdigest(w, SEED)
            if len(w) < 64:
                _WORDS[w] = h
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    k = min(words, len(h))
    n, mixed = len(h) - k + 1, np.full(len(h) - k + 1, k, np.uint64)
    for i, m in enumerate(_odd_numbers(k)):
        mixed = (mixed ^ h[i:i + n]) * m
        mixed ^= mixed >> np.uint64(29)
    return np.unique(mixed)


def signature(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """(sets, coordinates): the minimum of each of the hash functions over each set; sets are not empty."""
    by, mask = _odd_numbers(2 * coordinates).reshape(2, coordinates)
    heads = np.concatenate(([0], np.cumsum([len(s) for s in sets])))[:-1]
    flat = np.concatenate(sets)
    out = np.empty((len(sets), coordinates), np.uint64)
    for i in range(coordinates):
        h = (flat ^ mask[i]) * by[i]
        h ^= h >> np.uint64(32)
        out[:, i] = np.minimum.reduceat(h, heads)
    return out


def batches_of(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Stretches (from, to) of about ``STEP`` shingles."""
    a = size = 0
    for i, s in enumerate(sets):
        size += len(s)
        if size >= STEP:
            yield a, i + 1
            a, size = i + 1, 0
    if a < len(sets):
        yield a, len(sets)


def signed_rows(src: DataFrame, words: int, coordinates: int) -> DataFrame:
    """doc_id, row_hash, n_shingles, set_key (null without shingles), values: one long per coordinate that also tells the coordinate."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for b in batches:
            sets = [shingles(t, words) for t in b.column(1).to_pylist()]
            some = [s for s in sets if len(s)]
            values: list = []
            for a, z in batches_of(some):
                v = signature(some[a:z], coordinates)
                v = (v >> np.uint64(8)) ^ (np.arange(coordinates, dtype=np.uint64)[None, :] << np.uint64(56))
                values += v.view(np.int64).tolist()
            it = iter(values)
            yield pa.record_batch([
                b.column(0), b.column(2), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([xxhash.xxh3_128_digest(s.tobytes(), SEED) if len(s) else None for s in sets], pa.binary()),
                pa.array([next(it) if len(s) else None for s in sets], pa.list_(pa.int64()))], names=["doc_id", "row_hash", "n_shingles", "set_key", "values"])
    kind = src.schema["doc_id"].dataType.simpleString()
    return src.select("doc_id", "text", "row_hash").mapInArrow(run, f"doc_id {kind}, row_hash long, n_shingles long, set_key binary, values array<long>")


def lookup(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """Inner join of rows with a table of one row a key, whose ``n`` says how many rows have it.

    Keys of over a thousandth of all rows, of which there are fewer than a
    thousand, are broadcast; the others are shuffled.
    """
    often = max(1000, total // 1000)
    hot = table.where(F.col("n") > often)
    seen = rows.join(F.broadcast(hot.select(F.col(key), F.lit(True).alias("_hot"))), key, "left")
    common = seen.where("_hot").drop("_hot").join(F.broadcast(hot), key)
    rest = seen.where("_hot is null").drop("_hot").join(table.where(F.col("n") <= often), key)
    return common.unionByName(rest)


class Joined:
    """Classes of the members of a group, joined as links are found."""

    def __init__(self, classes: np.ndarray):
        self.of = np.unique(classes, return_inverse=True)[1]

    def apart(self, x: int, others: np.ndarray) -> np.ndarray:
        return others[self.of[others] != self.of[x]]

    def link(self, x: int, others: np.ndarray) -> np.ndarray:
        """Join x and others; one of them for each class that was apart."""
        _, first = np.unique(self.of[others], return_index=True)
        new = np.isin(self.of, self.of[others])
        self.of[new] = self.of[x]
        return others[first]


def compare(classes: np.ndarray, side: np.ndarray, linked: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links that join members of different classes: all with one another, or those of side 1 with those of side 0."""
    j, out, n = Joined(classes), [], len(classes)
    both = bool(side.any())
    zero = np.flatnonzero(side == 0)
    for x in np.flatnonzero(side) if both else range(n):
        others = j.apart(x, zero if both else np.arange(x + 1, n))
        if len(others):
            near = others[linked(x, others)]
            if len(near):
                out += [(int(x), int(y)) for y in j.link(x, near)]
    return out


def _alike(t: pa.Table, percent: int, matches: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Test of collisions: sizes that allow the similarity and enough equal coordinates."""
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
    size = t["size"].to_numpy()

    def test(x: int, others: np.ndarray) -> np.ndarray:
        fits = 100 * np.minimum(size[x], size[others]) >= percent * np.maximum(size[x], size[others])
        fits[fits] = (sig[others[fits]] == sig[x]).sum(axis=1) >= matches
        return fits
    return test


def _equal_enough(t: pa.Table, percent: int, matches: int) -> Callable[[int, np.ndarray], np.ndarray]:
    """Exact test on full sets, after that of collisions."""
    alike, raw = _alike(t, percent, matches), t["set"].to_pylist()
    size = t["size"].to_numpy()
    flat, at = np.unique(np.frombuffer(b"".join(raw), np.uint64), return_inverse=True)
    ends = np.cumsum(size)
    sets = [at[e - s:e] for e, s in zip(ends.tolist(), size.tolist(), strict=True)]
    mark = np.zeros(len(flat), bool)

    def test(x: int, others: np.ndarray) -> np.ndarray:
        fits = alike(x, others)
        some = others[fits]
        if len(some):
            mark[sets[x]] = True
            heads = np.concatenate(([0], np.cumsum(size[some])))[:-1]
            common = np.add.reduceat(mark[np.concatenate([sets[y] for y in some.tolist()])].astype(np.int64), heads)
            mark[sets[x]] = False
            fits[fits] = 100 * common >= percent * (size[x] + size[some] - common)
        return fits
    return test


def _merger(make: Callable, percent: int, matches: int):
    """Links of all groups of one bundle; a group is (grp, cell), its members carry node, class and side."""
    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.lexsort((t["node"].to_numpy(), t["cell"].to_numpy(), t["grp"].to_numpy()))))
        grp, cell, node = (t[c].to_numpy() for c in ("grp", "cell", "node"))
        klass, side = t["class"].to_numpy(), t["side"].to_numpy()
        heads = np.flatnonzero(np.concatenate(([True], (grp[1:] != grp[:-1]) | (cell[1:] != cell[:-1])))) if len(grp) else np.zeros(0, int)
        a, b = [], []
        for s, e in zip(heads.tolist(), [*heads[1:].tolist(), len(grp)], strict=False):
            if e - s > 1:
                for x, y in compare(klass[s:e], side[s:e], make(t.slice(s, e - s), percent, matches)):
                    a.append(node[s + x])
                    b.append(node[s + y])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
    return run


def merge(members: DataFrame, chunk: int, per_bundle: int, make: Callable, percent: int, matches: int) -> DataFrame:
    """(node, root) for the nodes that links within groups join.

    ``members``: (grp, node, payload columns), written.  A group's chunks are compared
    one by one first; then members outside the group's largest class meet the other chunks.
    """
    run = _merger(make, percent, matches)
    sizes = members.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))
    sizes = stage(sizes.where("n > 1").select("grp", "n", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "sizes")
    total = members.count()
    placed = lookup(members, sizes, "grp", total).withColumn("chunk", F.pmod(F.xxhash64("node", "grp"), F.col("chunks")).cast("int")).drop("n")
    cells = placed.select("*", F.col("chunk").cast("long").alias("cell"), F.col("node").alias("class"), F.lit(0).alias("side"))
    bundle = F.pmod(F.xxhash64("grp", "cell"), F.lit(max(1, total // per_bundle)))  # most groups are small: many to a call
    first = stage(cells.withColumn("_bundle", bundle).groupBy("_bundle").applyInArrow(run, "a long, b long"), "inner")
    large = sizes.where("chunks > 1")
    if large.isEmpty():
        return components(first)
    # groups of several chunks whose members are of several classes
    roots = components(first)
    some = placed.where("chunks > 1").join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
    some = stage(some, "large")
    ranked = some.groupBy("grp", "class").agg(F.count(F.lit(1)).alias("k")).groupBy("grp") \
        .agg(F.max_by("class", F.struct("k", "class")).alias("main"), F.count(F.lit(1)).alias("classes"), F.sum("k").alias("n"))
    ranked = stage(ranked.where("classes > 1").drop("classes"), "ranked")
    some = stage(lookup(some, ranked, "grp", total).drop("n"), "several")
    strays = some.where("class <> main")
    # a chunk of strays meets every chunk of its group; strays of one chunk were compared already
    busy = strays.groupBy("grp", "chunk").agg(F.count(F.lit(1)).alias("k")).select("grp", F.col("chunk").alias("with")).distinct()
    met = some.join(F.broadcast(busy) if busy.count() < 100_000 else busy, "grp").where("with <> chunk").withColumn("side", F.lit(0))
    ours = strays.withColumn("_to", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).where("_to <> chunk").withColumn("side", F.lit(1))
    keep = [c for c in some.columns if c not in ("main", "chunk", "chunks")]
    cell = lambda stray, other: stray.cast("long") * F.lit(1 << 31) + other
    cells = met.select(*keep, "side", cell(F.col("with"), F.col("chunk")).alias("cell")) \
        .unionByName(ours.select(*keep, "side", cell(F.col("chunk"), F.col("_to")).alias("cell")))
    second = stage(cells.groupBy("grp", "cell").applyInArrow(run, "a long, b long"), "outer")
    if second.isEmpty():
        return roots
    # the classes found so far are stars already
    return components(second.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 85, coordinates: int = COORDINATES, matches: int = MATCHES,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (least id of the component), kept.

    Documents link when ``100 * intersection >= percent * union`` of their shingle sets.
    """
    if not 0 < matches <= coordinates <= 128:
        raise ValueError("matches must lie between 1 and the number of coordinates, at most 128")
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("row_hash", F.xxhash64("text"))
    rows = stage(signed_rows(src, words, coordinates), "signed")
    # equal sets are one node; its set is made from the row with the least hash, and of these the least id
    nodes = rows.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("least_id"), F.count(F.lit(1)).alias("n"), F.min(F.struct("row_hash", "doc_id")).alias("of"),
        F.first("n_shingles").alias("size"), F.first("values").alias("values"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    # pairs of coordinate and value that occur more than once, on the nodes that have enough of them
    posted = nodes.select("node", F.explode("values").alias("pair"))
    counts = stage(posted.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "pairs")
    shared = lookup(posted, counts, "pair", nodes.count() * coordinates)
    ordered = shared.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("n", "pair"))).alias("pairs")).where(F.size("pairs") >= matches)
    ordered = stage(ordered, "ordered")
    # eight bits of a coordinate tell nearly all values apart; that they sometimes don't only adds candidates
    sig = nodes.select("node", "size", F.expr("unhex(array_join(transform(values, x -> lpad(hex(x & 255), 2, '0')), ''))").alias("sig"))
    lists = ordered.select("node", F.explode(F.slice("pairs", 1, F.size("pairs") - F.lit(matches - 1))).alias("p")).join(sig, "node") \
        .select(F.col("p.pair").alias("grp"), "node", "size", "sig")
    clusters = stage(merge(stage(lists, "lists"), LIST_CHUNK, 1 << 14, _alike, percent, matches), "clusters")

    # full sets of the nodes in clusters
    wanted = nodes.select("node", F.col("of.row_hash").alias("_h"), F.col("of.doc_id").alias("_id")).join(clusters, "node").join(sig, "node")
    texts = src.join(wanted, (F.col("row_hash") == F.col("_h")) & F.col("doc_id").eqNullSafe(F.col("_id"))) \
        .select(F.col("root").alias("grp"), "node", "size", "sig", "text").dropDuplicates(["node"])
    sets = stage(_with_sets(texts, words), "sets")
    linked = stage(merge(sets, CLUSTER_CHUNK, 1 << 10, _equal_enough, percent, matches), "linked")

    # least id of each component, then of each row's set
    named = stage(nodes.select("set_key", "n", "least_id", "node").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node")), "named")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"), F.count(F.lit(1)).alias("n"))
    classes = stage(lookup(named.select("root", "set_key", F.col("n").alias("copies")), least, "root", named.count()).select("set_key", "component_id", F.col("copies").alias("n")), "classes")
    found = lookup(rows.where("set_key is not null").select("doc_id", "n_shingles", "set_key"), classes, "set_key", rows.count()).select("doc_id", "n_shingles", "component_id")
    out = found.unionByName(rows.where("set_key is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumnRenamed("doc_id", id_col)


def _with_sets(texts: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([shingles(t, words).tobytes() for t in b.column(4).to_pylist()], pa.binary())
            yield pa.record_batch([*b.columns[:4], sets], names=["grp", "node", "size", "sig", "set"])
    return texts.mapInArrow(run, "grp long, node long, size long, sig binary, set binary")
