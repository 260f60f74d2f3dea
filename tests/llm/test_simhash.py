import random
import re

import numpy as np
import pytest
import xxhash

from voxlab.llm.components import components
from voxlab.llm.simhash import fingerprint, hex_fingerprint, links, near_duplicates, one_of_each


def brute_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    h = [xxhash.xxh64(" ".join(w[i:i + 4]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, distance=4):
    """Least index of each index's component."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("text", [None, "", " \t", "One", "one TWO three", "É Ä straße İ one two Three four five", "a b c d", "x " * 50, "a b c d e\x1cf g"])
def test_fingerprint_by_definition(text):
    assert fingerprint(text) == brute_fingerprint(text)


def test_fingerprint_in_steps():
    rnd = random.Random(2)
    t = " ".join(rnd.choice("abcdefgh") * rnd.randrange(1, 5) for _ in range(300))
    assert fingerprint(t, step=7) == fingerprint(t) == brute_fingerprint(t)


def planted(n, seed):
    """Fingerprints with neighbours at 0 to 6 bits, chains of them and a dense ball."""
    rnd = random.Random(seed)
    out = [rnd.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = rnd.choice(out)
        for b in rnd.sample(range(64), rnd.randrange(0, 7)):
            x ^= 1 << b
        out.append(x)
    centre = rnd.getrandbits(64)
    out += [centre ^ sum(1 << b for b in rnd.sample(range(12), rnd.randrange(0, 6))) for _ in range(n)]
    return sorted(set(out))


@pytest.mark.parametrize("held", [1 << 21, 20_000])
def test_links_lose_no_component(spark, monkeypatch, held):
    monkeypatch.setattr("voxlab.llm.simhash.HELD", held)
    fps = planted(60, held)
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    found = {r.node: r.root for r in components(links(df)).collect()}
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    want = brute_components(fps)
    got = [found.get(s, s) for s in signed]
    assert [got.index(g) for g in got] == [want.index(w) for w in want]


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 5, 6])
def test_any_distance_against_brute_force(spark, monkeypatch, distance):
    monkeypatch.setattr("voxlab.llm.simhash.HELD", 1 << 18)
    rnd = random.Random(distance)
    fps = [rnd.getrandbits(64) for _ in range(12)]
    for a in list(fps):  # neighbours at every number of bits up to one beyond, and chains of them
        for d in range(1, distance + 2):
            a ^= sum(1 << b for b in rnd.sample(range(64), d))
            fps.append(a)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    at = {f: i for i, f in enumerate(fps)}
    found = [(at[r.a % (1 << 64)], at[r.b % (1 << 64)]) for r in links(df, distance).collect()]
    root = list(range(len(fps)))
    for _ in fps:
        for a, b in found:
            root[a] = root[b] = min(root[a], root[b])
    assert root == brute_components(fps, distance)


@pytest.mark.parametrize("distance", [3, 4])
def test_keys_stay_few_and_variants_are_divided_by_later_bits(spark, monkeypatch, distance):
    """Rows sent for a fingerprint don't grow with the number of fingerprints, as long as a key's fit."""
    monkeypatch.setattr("voxlab.llm.simhash.HELD", 1 << 9)
    fps = planted(40, distance)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    found = links(df, distance)
    generated = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "explode" in line]
    assert len(generated) == 1 and generated[0].count(",") < 1 + 7 + 21 + 5
    at = {f: i for i, f in enumerate(fps)}
    root, pairs = list(range(len(fps))), [(at[r.a % (1 << 64)], at[r.b % (1 << 64)]) for r in found.collect()]
    for _ in fps:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert root == brute_components(fps, distance)


def test_one_of_each_shuffles_texts_once(spark, frame):
    rows = [(i % 50, f"text number {i % 40} of many", "en", "s") for i in range(120)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = one_of_each(frame(rows))
        assert len(kept.collect()) == len({t for _, t, *_ in rows})
        plan = kept._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    final = plan.split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in final and final.count("Exchange") == 2  # the texts and the kept rows


def test_distances_that_are_not_spread(spark):
    with pytest.raises(ValueError):
        links(spark.createDataFrame([(1,)], "fp long"), 9)


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)] + [(500, 500), (70, 71), (71, 70)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}, 70: 70, 71: 70}


def texts(n, seed=6):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(2, 7)))
    base = [[word() for _ in range(rnd.randrange(30, 200))] for _ in range(n)]
    out = []
    for w in base:
        out.append(" ".join(w))
        if rnd.random() < 0.5:
            v = list(w)
            v[rnd.randrange(len(v))] = word()
            out += [" ".join(v), " ".join(w).upper()]
    return out


def test_query_against_brute_force(frame, odd):
    t = texts(80)
    rows = [(i, x, "en", "s") for i, x in enumerate(t)]
    fps = [brute_fingerprint(x) for x in t]
    df = near_duplicates(frame(rows))
    got = {r.doc_id: (r.f, r.component_id) for r in df.select("doc_id", hex_fingerprint(df["fp"]).alias("f"), "component_id").collect()}
    want = brute_components(fps)
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in range(len(t))}
    kept = one_of_each(frame(rows))
    assert kept.columns == frame(rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want))


def test_odd_rows(odd):
    got = [(r.doc_id, r.component_id) for r in near_duplicates(odd).collect()]
    assert len(got) == 10
    assert [c for i, c in got if i in (1, 2, 3)] == [1, 1, 1]
    assert [c for i, c in got if i == 4] == [4, 4] and (None, None) in got
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, None, 5, 6, 7, 7], key=str)


def test_empty_table(frame):
    assert near_duplicates(frame([])).collect() == [] and one_of_each(frame([])).collect() == []


def test_components_of_stars_take_no_step(spark, monkeypatch):
    """What is a set of stars already is seen from its least neighbours, without a round that changes nothing."""
    import voxlab.llm.components as C
    steps, write = [], C.stage
    monkeypatch.setattr(C, "stage", lambda df, name: steps.append(name) or write(df, name))
    stars = [(10 * i + j, 10 * i) for i in range(5) for j in range(1, 4)]
    got = {r.node: r.root for r in C.components(spark.createDataFrame(stars, "a long, b long")).collect()}
    assert got == {10 * i + j: 10 * i for i in range(5) for j in range(4)}
    assert steps == ["links", "least"]
