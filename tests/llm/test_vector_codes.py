import hashlib
import math
import random

import numpy as np
import pytest

from voxlab.llm.vector_codes import BLOCK, Shape, codebook_digest, compress, nearest, pack, unpack

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code string, error double, part string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, e, la, "x", "y", 0.5, "z", 3) for i, e, la in rows], SCHEMA)


def brute(rows, scale=1024, parts=4, entries=256, rounds=4):
    """The codes of the rows by plain loops over Python integers."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in e], la) for i, e, la in rows
            if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    longest = max((len(v) for _, v, _ in kept), default=0)
    dims = -(-longest // parts)
    kept = [(i, v + [0] * (parts * dims - len(v)), la, v) for i, v, la in kept]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    cut = lambda v: [v[p * dims:(p + 1) * dims] for p in range(parts)]
    books = [[cut(r[1])[p] for r in order[:entries]] for p in range(parts)]

    def best(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in book]
        return d.index(min(d)), min(d)
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in kept:
                x = cut(r[1])[p]
                groups.setdefault(best(x, books[p])[0], []).append(x)
            books[p] = [[sum(c) // len(c) for c in zip(*groups[e], strict=True)] if e in groups else b for e, b in enumerate(books[p])]
    out, by = [], {}
    for i, v, la, _ in kept:
        got = [best(x, books[p]) for p, x in enumerate(cut(v))]
        out.append((i, "".join(f"{k:02x}" for k, _ in got), sum(d for _, d in got), la))
        by[la] = by.get(la, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for c in b for x in c).encode()).hexdigest()
    return sorted(((i, c, e, by[la], digest) for i, c, e, la in out), key=str)


def ours(df, **kw):
    return sorted((tuple(r) for r in compress(df, **kw)[0].collect()), key=str)


@pytest.mark.parametrize("width,top", [(4, 1 << 30), (8, 1 << 39)])
def test_packed_order_is_that_of_the_rows(width, top):
    rng = random.Random(1)
    x = np.array([[rng.choice([-top, -1, 0, 1, top, rng.randrange(-top, top)]) for _ in range(3)] for _ in range(300)])
    packed = pack(x, width)
    assert [x[i].tolist() for i in np.argsort(packed, kind="stable")] == sorted(x.tolist())
    assert (unpack(packed.tobytes(), len(x), Shape(1, 3, 1, width)) == x).all()


@pytest.mark.parametrize("dims,values,top", [(1, 50, 1), (4, 3, 1), (6, 2, 1), (5, 1000, 1), (4, 5, 1 << 36)])
def test_trie_gives_the_nearest_entry(dims, values, top):
    rng = np.random.default_rng(dims)
    x = np.unique(rng.integers(-values, values, (400, dims)) * top, axis=0)
    book = rng.integers(-values, values, (17, dims)) * top
    k, far = nearest(x, book)
    d = ((x[:, None, :].astype(object) - book[None].astype(object)) ** 2).sum(axis=2)
    assert k.tolist() == [r.tolist().index(min(r)) for r in d]
    assert far.tolist() == [min(r) for r in d]


def test_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.01) for _ in range(8)], i % 3 or None) for i in range(60)]
    rows += [(i, rows[5][1], 9) for i in range(100, 160)]  # copies
    rows += [(200 + i, [rng.choice([0.0, 0.001, -0.001]) for _ in range(8)], 4) for i in range(60)]  # shared prefixes
    assert ours(frame(spark, rows), entries=16) == brute(rows, entries=16)


def test_odd_rows(spark):
    rows = [(3, [0.5, 0.25, 1.0], 1), (1, [1.0, 2.0, 3.0, 4.0, 5.0], None), (1, [1.0, 2.0, 3.0, 4.0, 4.0], None), (None, [9.0] * 5, 1), (4, [], 2),
            (2, None, 1), (5, [1.0, None], 1), (6, [float("nan")], 1), (7, [float("inf")], None), (8, [0.0] * 5, 2), (8, [0.0] * 5, 2)]
    for entries in (2, 3, 256):
        assert ours(frame(spark, rows), entries=entries) == brute(rows, entries=entries)


def test_empty_table_and_bounds(spark):
    assert ours(frame(spark, [])) == []
    assert ours(frame(spark, [(1, None, 1)])) == []
    assert [r[1:3] for r in ours(frame(spark, [(1, [], 1)]))] == [("00000000", 0)]
    with pytest.raises(ArithmeticError):
        compress(frame(spark, [(1, [1e30], 1)]))
    with pytest.raises(ValueError):
        compress(frame(spark, []), entries=257)


def test_hot_vector_over_blocks(spark):
    """One vector in more rows than a block; wide components."""
    rows = [(i, [0.5, -0.5, 0.25, 3.0e6], 1) for i in range(BLOCK + 50)] + [(100_000 + i, [i / 7, -i / 3, 0.1 * i, 3.0e6 + 64 * i], 2) for i in range(40)]
    assert ours(frame(spark, rows), entries=8, rounds=2) == brute(rows, entries=8, rounds=2)


def test_codebooks_are_returned(spark):
    df, books = compress(frame(spark, [(i, [float(i)] * 4, 1) for i in range(5)]))
    assert len(books) == 4 and books[0].shape == (5, 1)
    assert {r["codebooks_sha256"] for r in df.collect()} == {codebook_digest(books)}
