import random

import numpy as np
import pytest

from voxlab.llm import minhash as M

from .conftest import ODD

WORDS = [f"w{i}" for i in range(4000)]


def grams(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i:i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def brute(rows, words=5, percent=85):
    """Components by comparing all pairs of sets."""
    sets = [grams(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    got = [(d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]
    return sorted(((d, n, c, d == c) for d, n, c in got), key=str)


def ours(df, **kw):
    out = M.near_duplicates(df, **kw)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = rng.choice(WORDS)
    return w


def corpus(rng, singles, templates, copies, length=60):
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, length))) for _ in range(singles)]
    for _ in range(templates):
        base = [rng.choice(WORDS) for _ in range(length)]
        texts += [" ".join(edited(rng, base, rng.randrange(4))) for _ in range(copies)]
        texts += [" ".join(base[:length - rng.randrange(12)]) for _ in range(3)]
    rng.shuffle(texts)
    return texts


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
    b = np.concatenate((a[:850], rng.integers(0, 1 << 63, 60, dtype=np.uint64)))
    s = M.signature([np.unique(a), np.unique(b)], 2000)
    assert abs((s[0] == s[1]).mean() - 850 / 1060) < 0.04
    assert M.overlooked(0.85) < 2e-8 and M.overlooked(0.9) < 1e-11


def test_stretches_cover_all_sets():
    sets = [np.zeros(n, np.uint64) for n in (1, M.STEP, 3, 2, M.STEP + 1, 1)]
    cuts = list(M.batches_of(sets))
    assert [i for a, z in cuts for i in range(a, z)] == list(range(len(sets)))
    assert list(M.batches_of([])) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(frame, seed):
    rng = random.Random(seed)
    texts = corpus(rng, 60, 6, 12)
    texts += [t.upper().replace(" ", "\n\t") for t in texts[:5]] + texts[5:9]
    rows = list(enumerate(texts))
    assert ours(frame([(i, t, "en", "s") for i, t in rows]).repartition(3)) == brute(rows)


def test_large_groups_in_small_chunks(frame, monkeypatch):
    """Groups of many chunks, with members apart from the main class; a passage that half the documents share."""
    monkeypatch.setattr(M, "LIST_CHUNK", 8)
    monkeypatch.setattr(M, "CLUSTER_CHUNK", 8)
    rng = random.Random(4)
    texts = corpus(rng, 20, 1, 90, 40)
    common = " ".join(rng.choice(WORDS) for _ in range(30))
    texts += [common + " " + " ".join(rng.choice(WORDS) for _ in range(rng.randrange(12))) for _ in range(60)]
    rows = list(enumerate(texts))
    want = brute(rows)
    assert len({c for _, _, c, _ in want}) > 30
    assert ours(frame([(i, t, "en", "s") for i, t in rows])) == want


@pytest.mark.parametrize("words,percent", [(2, 50), (5, 100), (3, 70)])
def test_other_parameters(frame, words, percent):
    rng = random.Random(9)
    rows = list(enumerate(corpus(rng, 20, 3, 8, 30)))
    matches = max(m for m in range(1, 97) if M.overlooked(percent / 100, 96, m) < 1e-9) if percent < 100 else 96
    assert ours(frame([(i, t, "en", "s") for i, t in rows]), words=words, percent=percent, coordinates=96, matches=matches) == brute(rows, words, percent)


def test_compare_joins_each_class_once():
    near = lambda x, others: np.abs(others - x) <= 1
    assert len(M.compare(np.arange(6), np.zeros(6, int), near)) == 5
    assert M.compare(np.zeros(6, int), np.zeros(6, int), near) == []
    assert sorted(M.compare(np.arange(4), np.array([0, 1, 0, 0]), near)) == [(1, 0), (1, 2)]


def test_odd_rows_and_empty_table(odd, frame):
    assert ours(odd) == brute([(r[0], r[1]) for r in ODD])
    assert ours(frame([])) == []
    assert ours(frame([(1, None, "en", "s"), (None, "  ", "en", "s")])) == [(1, 0, 1, True), (None, 0, None, True)] 
    with pytest.raises(ValueError):
        M.near_duplicates(frame([]), matches=49)


def test_rows_without_ids(frame):
    t = "a b c d e f g"
    rows = [(None, t), (5, t), (3, t), (None, "x y"), (None, "x y"), (3, t)]
    assert ours(frame([(i, x, "en", "s") for i, x in rows])) == sorted(
        [(None, 3, 3, False), (5, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, 1, None, True), (None, 1, None, True)], key=str)
