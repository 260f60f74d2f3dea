import random
import zlib

import numpy as np
import pytest

from voxlab.llm.langid import Model, grams, identify
from voxlab.llm.quality import classify, features, fit, good_documents, learn, scored

LANGS = {"en": "the of and house tree window light", "fr": "le des et maison arbre fenêtre lumière", "de": "der und das haus baum fenster licht"}


def corpus(n, seed=2):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        lang = rnd.choice(list(LANGS))
        w = [rnd.choice(LANGS[lang].split()) + rnd.choice(["", "", "s", "en"]) for _ in range(rnd.randrange(8, 60))]
        good = rnd.random() < 0.7
        t = " ".join(w).capitalize() + "." if good else "!! ".join(w).upper() + " $$$ ### | |"
        docs.append((i, t, lang if i % 11 else None, rnd.choice("ab")))
        if i % 3:
            labels.append((i, int(good), 0))
    return docs, labels


def out(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_quality_on_held_out_rows(spark, frame):
    docs, labels = corpus(400)
    lab = spark.createDataFrame([*labels, (5, 1, 1), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in classify(frame(docs), lab).collect()}
    assert len(got) == 400 and all(0 <= r.score <= 1 and r.held_out == out(i) and r.predicted == int(r.score >= 0.5) for i, r in got.items())
    held = [(i, y) for i, y, _ in labels if out(i)]
    assert sum(got[i].predicted == y for i, y in held) >= 0.97 * len(held)
    kept = good_documents(frame(docs), lab)
    assert kept.columns == frame(docs).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.predicted}


def test_held_out_labels_and_other_columns_are_no_input(spark, frame):
    docs, labels = corpus(200)
    schema = "doc_id long, quality int, toxic int"
    a = {r.doc_id: r.score for r in classify(frame(docs), spark.createDataFrame(labels, schema)).collect()}
    turned = [(i, 1 - y if out(i) else y, 1) for i, y, _ in labels]
    b = {r.doc_id: r.score for r in classify(frame([(i, t, "xx", None) for i, t, *_ in docs]), spark.createDataFrame(turned, schema)).collect()}
    assert a == pytest.approx(b)


def test_quality_of_odd_rows(spark, odd, frame):
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in classify(odd, empty).collect()] == [0.5] * 10
    docs, labels = corpus(100)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = classify(frame(docs).unionByName(odd), lab).collect()
    assert len(rows) == 110 and all(0 <= r.score <= 1 for r in rows) and not any(r.held_out for r in rows if r.doc_id is None)
    assert good_documents(frame([]), lab).collect() == []


def test_ranking_orders_pairs():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 19))
    y = (x[:, 2] - x[:, 5] > 0).astype(int)
    m = fit(x, y, pairs=4000)
    s = scored(x, m)
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.98
    assert abs((s >= 0.5).mean() - y.mean()) < 0.02  # the threshold is the quantile of the low share


def test_all_pairs_count():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 19))
    y = (x[:, 1] + rng.normal(size=120) > 0).astype(int)
    m = fit(x, y)
    z = np.clip((x - x.mean(axis=0)) / (x.std(axis=0) + 1e-6), -8, 8)
    d = (z[y == 1][:, None] - z[y == 0][None, :]).reshape(-1, 19)
    slope = -(d / (1 + np.exp(d @ m["w"]))[:, None]).mean(axis=0) + 1e-3 * m["w"]
    assert np.abs(slope).max() < 1e-4  # the least loss over every pair


def test_model_is_learnt_from_every_labelled_row(spark, frame):
    """25,000 rows to learn from, more than any sample of 20,000 holds, give the constants of all of them."""
    rows = [(i, "a" * (i % 7 + 1) + " B" * (i % 5) + "!" * (i % 3), "en", "s") for i in range(37_500)]
    own = [(i, t) for i, t, *_ in rows if not out(i)]
    lab = spark.createDataFrame([(i, int(i % 7 + i % 3 > 3), 0) for i, *_ in rows], "doc_id long, quality int, toxic int")
    kept = {t: features(t) for t in {t for _, t in own}}
    x, y = np.array([kept[t] for _, t in own]), np.array([int(i % 7 + i % 3 > 3) for i, _ in own])
    got, want = learn(frame(rows), lab), fit(x, y)
    assert len(own) > 20_000 and got["low"] == pytest.approx((y == 0).mean())
    for part in ("mean", "scale", "w", "cut", "unit"):
        assert got[part] == pytest.approx(want[part], abs=1e-6), part


def test_language_on_held_out_rows(frame):
    docs, _ = corpus(300)
    got = {r.doc_id: r for r in identify(frame(docs)).collect()}
    rnd = random.Random(2)
    held = [d for d in docs if out(d[0]) and d[2]]
    assert sum(got[i].lang_pred == la for i, _, la, _ in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.held_out == out(i) for i, r in got.items())
    shuffled = [(i, t, rnd.choice(list(LANGS)) if out(i) else la, "z") for i, t, la, _ in docs]
    assert {r.doc_id: (r.lang_pred, r.score) for r in identify(frame(shuffled)).collect()} == {i: (r.lang_pred, r.score) for i, r in got.items()}


def test_a_small_language_is_learnt_beside_large_ones(frame):
    """Nine hundred rows of two languages to forty of a third, and a sample of thirty rows each."""
    docs, _ = corpus(900)
    rnd = random.Random(8)
    third = "ja nie tak dom kot pies woda ogień drzewo szkoła miasto rzeka góra niebo słońce".split()
    small = [(5000 + i, " ".join(rnd.choice(third) for _ in range(40)), "pl", "s") for i in range(40)]
    got = {r.doc_id: r for r in identify(frame(docs + small), max_rows=30).collect()}
    for lang in {d[2] for d in docs + small if d[2]}:
        held = [d for d in docs + small if out(d[0]) and d[2] == lang]
        assert held and sum(got[i].lang_pred == la for i, _, la, _ in held) >= 0.95 * len(held), lang


def test_language_of_odd_rows(odd, frame):
    docs, _ = corpus(100)
    rows = identify(odd.unionByName(frame([(1000 + i, t, la, s) for i, t, la, s in docs])).unionByName(frame([(9, "123 +-² !", "en", "a")]))).collect()
    by = {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 for i in (1, 2, 3, 9)) and len(by[4]) == 2
    assert {r.lang_pred for r in identify(odd.where("lang is null")).collect()} == {"und"}
    assert identify(frame([])).collect() == []


def test_backoff_takes_the_longest_known_grams():
    m = Model([("tree", 0, "en", 5), ("arbre", 0, "fr", 5), (" tre", 4, "en", 3), ("ar", 2, "fr", 9), ("ar", 2, "en", 1), ("t", 1, "fr", 50),
               ("xxxx", 4, "fr", 3), ("xy", 2, "en", 9), ("e", 1, "en", 50)])  # a frequency is a share of its language's items
    assert m.predict("tree")[0] == "en"
    assert m.predict("tres")[0] == "en"  # a known 4-gram, so the single letters don't count
    assert m.predict("bar")[0] == "fr"
    assert m.predict("tx")[0] == "fr"
    assert grams("ab", 2) == [" a", "ab", "b "] and grams("ab", 1) == ["a", "b"]
