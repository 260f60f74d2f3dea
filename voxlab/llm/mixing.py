"""Mixing sources to target weights by Pareto order sampling (DataFrame functions only).

Every source gets a target number of words: shares by weight of all words,
none above ``max_repeat`` times what the source holds, the excess shared again
by weight among the others.  A source whose target is f times its words takes
floor(f) whole copies of each document for certain; of what is left to take,
R words, a document of size x has inclusion probability ``min(1, R x / sum x^2)``
(the one proportional to size whose expected words are R).  Pareto order
sampling ranks a source's documents by (U / (1 - U)) / (p / (1 - p)), U a fixed
hash of the document, and takes them in that order as long as they fit into the
R words: a sample of fixed size, counted in words as the targets are.  The
document that doesn't fit is set aside, and what is ranked after it goes on in the
same way with the words left, until nothing left fits; then the shortest
document left is taken if that brings the source nearer to its target.

Rows equal in source, id and text are one entry with a number, so copies of any
number share one row and one rank; how many of them are drawn is a division.

A source may hold any share of all rows, so it is never ordered as a whole.
Its ranks are cut into buckets, word totals per bucket (partial aggregates)
tell which bucket holds the cut, and only that bucket is cut again, twice;
the last cut orders the entries that share one of 2^30 rank values.  A round
goes on with the entries that still fit, so each is smaller than the one before.

Defined results: null or empty texts have size 0 and are taken 0 words; a null
source is a source of its own, ordered last; a source without words has target
0; identical rows are interchangeable; an empty table gives an empty result.
The choice depends on id and text alone, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

WORD = r"[^\x20\x09-\x0D]+"
#: Ranks are cut into 2^LEVEL_BITS buckets, thrice.
LEVEL_BITS, LEVELS = 10, 3
#: Copies of one row that are made at a time.
CHUNK = 1 << 16


def word_count(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null: 0.

    Counts where such a run begins: with white space made spaces and a space
    put in front, squeezing the spaces leaves one per run.
    """
    spaced = F.translate(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), "\t\n\x0b\x0c\r", "     ")
    squeezed = F.rtrim(F.regexp_replace(spaced, " {2,}", " "))
    return (F.length(squeezed) - F.length(F.translate(squeezed, " ", ""))).cast("long")


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """Rows with their position (from 0) in a global order, without a one-task window.

    The sorted rows are written with their partition and place in it; the row
    counts per partition, one row each, give the offsets.
    """
    part, place = F.shiftright(F.col("_at"), 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    rows = stage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumns({"_part": part, "_place": place})
    before = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(before.select("_part", "_before"), "_part") \
        .withColumn(out, F.col("_before") + F.col("_place")).drop("_part", "_place", "_at", "_before")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: float = 3.0) -> DataFrame:
    """Per source: source_size, size2 (sum of squared sizes), target.

    A level t gives each source min(max_repeat * size, t * weight); the sources
    at their bound only grow in number as t does, so t is found by repeated
    sums over the sources until that number stands.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"),
                                     F.sum(F.col("size").cast("double") * F.col("size")).alias("size2"))
    rows = numbered(by, [F.col("source").asc_nulls_last()], "_k")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int"))
    rows = stage(rows.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(max_repeat)).drop("_k"), "sources")
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, held = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("bound") <= F.lit(level) * F.col("weight")
        n, used, rest = rows.agg(F.count(F.when(full, 1)), F.coalesce(F.sum(F.when(full, F.col("bound"))), F.lit(0.0)),
                                 F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == held or rest == 0:
            break
        held, level = n, (total - used) / rest
    target = F.least(F.col("bound").cast("double"), F.lit(float(level or 0)) * F.col("weight"))
    return rows.select("source", "source_size", "size2", target.alias("target"))


def _of_source(df: DataFrame, by: DataFrame) -> DataFrame:
    """``df`` with the columns of ``by``, one row for each source, where there is one."""
    by = by.withColumnRenamed("source", "_s")
    return df.join(by, df["source"].eqNullSafe(by["_s"]), "left").drop("_s")


def _judged(rows: DataFrame) -> DataFrame:
    """Entries with ``drawn``: how many of each are taken before the first one that doesn't fit into ``left``.

    Level by level, the first bucket whose words pass ``left`` holds that entry.
    """
    mask, cut = (1 << LEVEL_BITS) - 1, None
    for level in range(LEVELS):
        shift = LEVEL_BITS * (LEVELS - 1 - level)
        at = rows.withColumn("_b", F.shiftright("_rank", shift).bitwiseAND(mask))
        if cut is None:
            at = at.withColumns({"_prefix": F.lit(0).cast("long"), "_base": F.lit(0).cast("long")})
        else:
            at = _of_source(at, cut.withColumnRenamed("_before", "_base")).where(F.shiftright("_rank", shift + LEVEL_BITS) == F.col("_prefix"))
        sums = at.groupBy("source", "left", "_prefix", "_base", "_b").agg(F.sum(F.col("size") * F.col("n")).alias("_w"))
        w = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("_before", F.col("_base") + F.coalesce(F.sum("_w").over(w), F.lit(0)))
        passed = sums.where(F.col("_before") + F.col("_w") > F.col("left"))
        cut = passed.groupBy("source").agg(F.min_by(F.struct(F.shiftleft("_prefix", LEVEL_BITS).bitwiseOR(F.col("_b")).alias("p"), "_before"), "_b").alias("_c")) \
            .select("source", F.col("_c.p").alias("_prefix"), F.col("_c._before").alias("_before"))
        cut = stage(cut, f"cut{level}")
    rows = _of_source(rows, cut.withColumnRenamed("_prefix", "_cut"))
    # only entries of the very rank value that holds the cut are ordered
    w = Window.partitionBy("source").orderBy("row_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    ties = rows.where(F.col("_rank") == F.col("_cut")) \
        .withColumn("_room", F.col("left") - F.col("_before") - F.coalesce(F.sum(F.col("size") * F.col("n")).over(w), F.lit(0)))
    ties = ties.withColumn("drawn", F.greatest(F.lit(0), F.least(F.col("n"), F.floor(F.col("_room") / F.col("size")))).cast("long")).drop("_room")
    others = rows.where(F.col("_cut").isNull() | (F.col("_rank") != F.col("_cut"))) \
        .withColumn("drawn", F.when(F.col("_cut").isNull() | (F.col("_rank") < F.col("_cut")), F.col("n")).otherwise(0).cast("long"))
    return others.unionByName(ties).drop("_cut", "_before")


def _drawn(entries: DataFrame) -> DataFrame:
    """Entries with ``drawn``, the copies of each that are taken beyond the whole ones (0 to n)."""
    fits = (F.col("size") > 0) & (F.col("size") <= F.col("left"))
    rows, parts = entries.withColumn("left", F.col("rest")), []
    while True:
        parts.append(rows.where(~fits).withColumn("drawn", F.lit(0).cast("long")))
        rows = stage(rows.where(fits), "fitting")
        if rows.isEmpty():
            break
        judged = stage(_judged(rows), "judged")
        used = stage(judged.groupBy("source").agg(F.sum(F.col("drawn") * F.col("size")).alias("_used")), "used")
        parts.append(judged.where("drawn > 0"))
        rows = _of_source(judged.where("drawn = 0").drop("drawn"), used).withColumn("left", F.col("left") - F.col("_used")).drop("_used")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = stage(out.drop("left"), "drawn")
    # the shortest entry that is left, where it is less than twice as long as what a source lacks
    lacks = out.groupBy("source").agg((F.first("rest") - F.sum(F.col("drawn") * F.col("size"))).alias("_lacks"),
                                      F.min(F.when((F.col("drawn") < F.col("n")) & (F.col("size") > 0), F.struct("size", "row_key", "doc_id"))).alias("_least"))
    lacks = stage(lacks.where(F.col("_least.size") < 2 * F.col("_lacks")).select("source", "_least"), "lacking")
    one = F.coalesce(F.struct("size", "row_key", "doc_id").eqNullSafe(F.col("_least")) & F.col("_least").isNotNull(), F.lit(False))
    return _of_source(out, lacks).withColumn("drawn", F.col("drawn") + one.cast("long")).drop("_least")


def _rank(size: Column, row_key: Column, seed: int) -> Column:
    """Rank of an entry in its source's order; beside it stand the source's ``rest`` and ``size2``."""
    u = (F.pmod(F.xxhash64(row_key, F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    p = F.least(F.lit(1.0), F.col("rest") * size / F.greatest(F.col("size2"), F.lit(1.0)))
    # the rank key q / (1 + q) of q = u (1 - p) / ((1 - u) p) lies in [0, 1] and keeps the order
    a, b = u * (1 - p), (1 - u) * p
    return F.floor(F.when(p > 0, a / (a + b)).otherwise(F.lit(1.0)) * F.lit(float((1 << (LEVEL_BITS * LEVELS)) - 1))).cast("long")


def _ranked_entries(docs: DataFrame, weights: tuple[float, ...], max_repeat: float, id_col: str, text_col: str, source_col: str,
                    seed: int) -> tuple[DataFrame, DataFrame]:
    """The entries with ``_rank`` and ``rest``, and per source what ranks them."""
    key = F.xxhash64(F.col(id_col), F.col(text_col))
    sizes = stage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                              word_count(F.col(text_col)).alias("size"), key.alias("row_key")), "sizes")
    targets = stage(source_targets(sizes, weights, max_repeat), "targets")
    t = targets.withColumn("whole", F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))))
    t = t.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    rows = _of_source(sizes.groupBy("source", "doc_id", "size", "row_key").agg(F.count(F.lit(1)).alias("n")), t)
    rows = rows.withColumn("_rank", _rank(F.col("size"), F.col("row_key"), seed))
    return _drawn(stage(rows.drop("size2"), "ranked")), t


def mixed_entries(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: float = 3.0, id_col: str = "doc_id",
                  text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """Per distinct (source, id, text): n rows, ``whole`` copies of each of them, ``drawn`` of them once more.

    ``row_key`` is a hash of id and text, for joining back to the rows.
    """
    return _ranked_entries(docs, weights, max_repeat, id_col, text_col, source_col, seed)[0].drop("_rank", "rest")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: float = 3.0, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source", seed: int = 7) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words, repeats counted), copies and row_key."""
    entries = stage(mixed_entries(docs, weights, max_repeat, id_col, text_col, source_col, seed), "entries")
    # equal rows are made again from their number, many of them in chunks dealt over the tasks
    few = entries.where(F.col("n") <= CHUNK).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    many = entries.where(F.col("n") > CHUNK).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK))))
    many = many.repartition("row_key", "_c").withColumn("_i", F.explode(F.sequence(F.col("_c") * CHUNK + 1, F.least(F.col("n"), (F.col("_c") + 1) * CHUNK)))).drop("_c")
    copies = F.when(F.col("size") > 0, F.col("whole") + (F.col("_i") <= F.col("drawn")).cast("long")).otherwise(0).cast("long")
    return few.unionByName(many).select(F.col("doc_id").alias(id_col), "size", "source_size", "target", (copies * F.col("size")).alias("taken"),
                                        copies.alias("copies"), "row_key", F.col("source").alias(source_col))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: float = 3.0, id_col: str = "doc_id",
               text_col: str = "text", source_col: str = "source", copy_col: str = "copy", seed: int = 7) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it has copies, numbered from 1 in ``copy_col``.

    Nearly all rows find their number of copies where they stand: in a source's order all that fit are
    taken up to the first entry that doesn't, which is one rank a source.  What is taken after
    it has fewer words than that entry in all; those entries, and rows equal in id, text and source, of which
    one stands for all and is repeated as often as all of them together, are met by id and text hash.
    """
    cols = docs.columns
    names = [f"c{i}" for i in range(len(cols))]
    own = [names[cols.index(c)] for c in (id_col, text_col, source_col)]
    entries, sources = _ranked_entries(docs.select(*[F.col(c) for c in (id_col, text_col, source_col)]), weights, max_repeat, id_col, text_col, source_col, seed)
    entries = stage(entries.where("size > 0"), "entries")
    fits = F.col("size") <= F.col("rest")
    cut = stage(entries.where(fits & (F.col("drawn") < F.col("n"))).groupBy("source").agg(F.min("_rank").alias("_cut")), "cut")
    first = fits & (F.col("_cut").isNull() | (F.col("_rank") < F.col("_cut")))
    others = _of_source(entries, cut).where((F.col("n") > 1) | (F.col("drawn") != first.cast("long")))
    others = stage(others.select("row_key", F.col("source").alias("_s"), "n", (F.col("whole") * F.col("n") + F.col("drawn")).alias("_sum")), "others")
    rule = stage(_of_source(sources, cut).select("source", "whole", "rest", "size2", "_cut"), "rule")
    d = docs.toDF(*names).withColumns({"_key": F.xxhash64(own[0], own[1]), "_from": F.col(own[2]).cast("string")})

    def met(some: DataFrame, how: str = "inner") -> DataFrame:
        return d.join(some, (d["_key"] == some["row_key"]) & d["_from"].eqNullSafe(some["_s"]), how)
    here = met(others, "left").where("n is null or n = 1").select(*names, "_key", "_from", "_sum", word_count(F.col(own[1])).alias("size"))
    here = here.join(rule, here["_from"].eqNullSafe(rule["source"])).withColumn("_rank", _rank(F.col("size"), F.col("_key"), seed))
    usual = F.when(F.col("size") > 0, F.col("whole") + first.cast("long")).otherwise(0)
    here = here.select(*names, F.coalesce(F.col("_sum"), usual).alias("_sum"))
    repeated = met(others.where("n > 1")).dropDuplicates(["_key", "_from"]).select(*names, "_sum")
    out = here.unionByName(repeated).where("_sum > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_sum").cast("int"))))
    return out.select(*names, "_copy").toDF(*cols, copy_col)
