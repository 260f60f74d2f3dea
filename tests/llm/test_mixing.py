import random
import re

import pytest

from voxlab.llm.mixing import mix, mixed_rows, numbered, source_targets
from pyspark.sql import functions as F


def targets(sizes, bound=3.0):
    """Brute force: sources by code point, null last, weights 1, 2, 3, excess shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: 1 + i % 3 for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(bound * sizes[s] for s in full)
        level = left / max(1, sum(w[s] for s in rest))
        over = {s for s in rest if level * w[s] >= bound * sizes[s]}
        if not over or not rest:
            return {s: bound * sizes[s] if s in full else level * w[s] for s in names}
        full |= over


def documents(n, seed=1):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        s = rnd.choice(["hot"] * 5 + ["a", "b", "Ä", "z", None, "tiny"] if i else ["tiny"])
        out.append((i, " ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.randrange(0, 120))), "en", s))
    return out


def test_mix_against_brute_force(frame):
    rows = documents(1500)
    got = mix(frame(rows)).collect()
    assert len(got) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, *_ in rows}
    by = {}
    for i, _, _, s in rows:
        by[s] = by.get(s, 0) + size[i]
    want = targets(by)
    taken = {}
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == by[r.source]
        assert r.target == pytest.approx(want[r.source])
        assert r.taken % max(1, r["size"]) == 0 and r.taken <= 3 * r["size"]
        assert r.taken in ((r.target // r.source_size) * r["size"], (r.target // r.source_size + 1) * r["size"])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 120  # half of the document at the cut, and at most one document
    again = {r.doc_id: r.taken for r in mix(frame(rows[::-1]).repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in got}


def test_excess_is_shared_again(frame):
    rows = [(i, "w " * 10, "en", "big") for i in range(100)] + [(1000, "w", "en", "one"), (1001, "w w", "en", "two")]
    got = {r.source: (r.source_size, r.target) for r in mix(frame(rows)).collect()}
    assert got["one"] == (1, 3.0) and got["two"] == (2, 6.0) and got["big"][1] == pytest.approx(1003 - 9)


def test_larger_documents_are_likelier(frame):
    rows = [(i, "w " * (1 if i % 2 else 30), "en", "a" if i < 800 else "b") for i in range(1200)]
    got = [r for r in mix(frame(rows), weights=(1, 3)).collect() if r.source == "a"]
    drawn = lambda n: sum(r.copies > 0 for r in got if r["size"] == n) / sum(r["size"] == n for r in got)
    assert drawn(30) > 3 * drawn(1)


def test_odd_rows(odd):
    got = sorted((tuple(r)[:5] for r in mix(odd).collect()), key=str)
    assert len(got) == 10
    assert [r for r in got if r[0] == 1] == [(1, 0, 12, pytest.approx(36.0), 0)]
    assert all(r[4] <= 3 * r[1] for r in got)


def test_empty_table(frame):
    assert mix(frame([])).collect() == [] and mixed_rows(frame([])).collect() == []


def test_rows_without_words(frame):
    assert [r.taken for r in mix(frame([(1, " ", "en", "a"), (2, None, "en", None)])).collect()] == [0, 0]


def test_mixed_rows_repeat_as_taken(odd):
    want = sum(r.copies for r in mix(odd).collect())
    got = mixed_rows(odd)
    assert got.columns == [*odd.columns, "copy"]
    assert got.count() == want


def test_numbered_is_a_global_rank(spark):
    df = spark.range(1000).repartition(7).select((F.col("id") * 7 % 1000).alias("x"))
    assert [tuple(r) for r in numbered(df, [F.col("x")], "k").select("x", "k").orderBy("x").collect()] == [(i, i) for i in range(1000)]


def test_targets_of_one_source(frame):
    df = frame([(1, "a b", "en", "s")]).select(F.lit(2).cast("long").alias("size"), "source").select("source", "size")
    (r,) = source_targets(df).collect()
    assert r.target == pytest.approx(2.0)


def brute_draw(rows, bound=3.0, seed_rank=None):
    """Plain form: documents in rank order as they fit, set aside otherwise; at the end the shortest one that helps."""
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    taken = {}
    for s, own in by.items():
        rest = own[0].target - (own[0].target // max(1, own[0].source_size)) * own[0].source_size
        order, left = sorted((r for r in own if r["size"] > 0), key=lambda r: (seed_rank[r.row_key], r.row_key)), rest
        drawn = []
        for r in order:
            if r["size"] <= left:
                drawn.append(r)
                left -= r["size"]
        if (out := [r for r in order if r not in drawn]) and (least := min(r["size"] for r in out)) < 2 * left:
            left -= least
        taken[s] = (own[0].target // max(1, own[0].source_size)) * own[0].source_size + rest - left
    return taken


def test_draw_goes_on_as_the_plain_form(frame):
    rnd = random.Random(5)
    rows = [(i, " ".join(["w"] * max(1, int(rnd.paretovariate(0.8)))), "en", rnd.choice(["a", "a", "b", None])) for i in range(800)]
    rows = [(i, t[:40000], la, s) for i, t, la, s in rows]
    got = mix(frame(rows)).collect()
    size2 = {}
    for r in got:
        size2[r.source] = size2.get(r.source, 0) + r["size"] ** 2

    def rank(r):
        u = float(hashes[r.row_key] % (1 << 52) + 0.5) / (1 << 52)
        rest = r.target - (r.target // r.source_size) * r.source_size
        p = min(1.0, rest * r["size"] / max(size2[r.source], 1.0))
        a, b = u * (1 - p), (1 - u) * p
        return int((a / (a + b) if p > 0 else 1.0) * float((1 << 30) - 1))
    spark = frame([]).sparkSession
    keys = spark.createDataFrame([(r.row_key,) for r in got], "k long")
    hashes = {k: h for k, h in keys.select("k", F.xxhash64("k", F.lit(7))).collect()}
    want = brute_draw(got, seed_rank={r.row_key: rank(r) for r in got})
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert taken == {s: pytest.approx(w) for s, w in want.items()}


@pytest.mark.parametrize("others", [140_000, 50_000])
def test_a_refused_long_document_leaves_its_words_to_others(frame, others):
    rows = [(0, "w " * 1_000_000, "en", "a")] + [(i, "w " * 300, "en", "a") for i in range(1, 1001)]
    rows += [(5000 + i, "w " * 1000, "en", s) for s in "bc" for i in range(others // 1000)]
    got = mix(frame(rows)).where("source = 'a'").collect()
    target, taken = got[0].target, sum(r.taken for r in got)
    # the 300,000 words that fit are taken; what is left out would lead further away
    assert taken >= 300_000 and all(r["size"] >= 2 * (target - taken) for r in got if not r.taken)


def test_equal_rows_are_dealt_in_one_division(frame, monkeypatch):
    import voxlab.llm.mixing as mixing
    monkeypatch.setattr(mixing, "CHUNK", 64)
    rows = [(1, "same words here", "en", "a")] * 500 + [(i, "w " * 7, "en", "b") for i in range(2, 300)]
    docs = frame(rows)
    got = mix(docs).collect()
    a = [r for r in got if r.doc_id == 1]
    assert len(got) == len(rows) and len(a) == 500
    assert abs(sum(r.taken for r in a) - a[0].target) <= 1.5
    assert mixed_rows(docs).where("doc_id = 1").count() == sum(r.copies for r in a)


def test_texts_stay_where_they_are(frame):
    """Rows find their copies by their source's cut: no shuffle of the texts once the entries are too many to broadcast."""
    rows = documents(6000, seed=3)
    docs = frame(rows + rows[:5] + [(7, "zero one", "en", None)] * 4)
    conf = docs.sparkSession.conf
    before = conf.get("spark.sql.autoBroadcastJoinThreshold")
    conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
    try:
        got = mixed_rows(docs)
        n, plan = got.groupBy("doc_id", "text", "source").count().collect(), None
        got.collect()
        plan = got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        want = mix(docs).groupBy("doc_id", "source", "row_key").agg(F.sum("copies").alias("n")).where("n > 0").collect()
    finally:
        conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((str(r.doc_id), str(r.source), r["count"]) for r in n) == sorted((str(r.doc_id), str(r.source), r.n) for r in want)
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") <= 1  # equal rows alone
