import datetime
import random
import time
from itertools import combinations

import numpy as np
import pytest

from voxlab.llm.decontaminate import MASKS, Seeds, clean_documents, longest, overlaps, words


def brute_longest(same, s):
    best = 0
    for i in range(len(same)):
        for j in range(i + 1, len(same) + 1):
            if sum(same[i:j]) >= s * (j - i) - 1e-9:
                best = max(best, j - i)
    return best


def brute(text, items, least=16, similarity=0.8):
    """Items laid on every place of the text."""
    w, out = words(text), set()
    for i, t in items:
        v = words(t)
        for start in range(-len(v) + 1, len(w)):
            same = [0 <= start + k < len(w) and w[start + k] == v[k] for k in range(len(v))]
            same = same[max(0, -start):max(0, -start) + min(len(v), len(w) - start) - max(0, -start)]
            if v and brute_longest(same, similarity) >= min(least, len(v)):
                out.add(i)
    return out


def test_masks_survive_three_substitutions_in_sixteen_words():
    places = [{s + i for i, c in enumerate(m) if c == "1"} for m in MASKS for s in range(16 - len(m) + 1)]
    for lost in combinations(range(16), 3):
        assert any(not p & set(lost) for p in places), lost


def test_longest_by_definition():
    rnd = random.Random(1)
    for _ in range(300):
        same = np.array([rnd.random() < 0.75 for _ in range(rnd.randrange(0, 40))], bool)
        lo, hi = longest(same, 0.8)
        assert hi - lo == brute_longest(same.tolist(), 0.8)
        assert not hi or same[lo:hi].mean() >= 0.8 - 1e-9


def planted(seed=3):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(text(rnd.randrange(16, 50)))) for i in range(20)] + [(20, "a b c d e f g"), (21, ""), (22, None), (23, "x y")]
    docs, held = [], {}
    for d in range(60):
        w = text(rnd.randrange(10, 150))
        if d % 3 == 0:
            i, t = rnd.choice(items[:20])
            v = t.split()
            for k in rnd.sample(range(len(v)), rnd.randrange(0, len(v) // 6)):
                v[k] = "other"
            a = rnd.randrange(len(w))
            w[a:a] = v
            held[d] = i
        docs.append((d, (" " if d % 2 else "\n, ").join(w).upper() if d % 5 == 0 else " ".join(w), "en", "s"))
    docs.append((60, "so a b c d e f g it is", "en", "s"))
    held[60] = 20
    return docs, items, held


@pytest.mark.parametrize("block", [500_000, 60])
def test_overlaps_against_brute_force(spark, frame, block):
    docs, items, held = planted()
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, n_words long")
    got = {(r.doc_id, r.item_id) for r in overlaps(frame(docs), bench, block_words=block).collect()}
    want = {(d, i) for d, t, *_ in docs for i in brute(t, [(i, t or "") for i, t in items])}
    assert got == want and set(held.items()) <= got
    clean = clean_documents(frame(docs), bench, block_words=block)
    assert clean.columns == frame(docs).columns
    assert sorted(r.doc_id for r in clean.collect()) == sorted({d for d, *_ in docs} - {d for d, _ in want})


def test_odd_rows(spark, odd, frame):
    bench = spark.createDataFrame([(1, "one two three four five"), (1, "one two three four five"), (None, "the long text goes on and on")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in overlaps(odd, bench).collect()), key=str)
    assert got == [(6, None), (7, 1), (7, 1)]
    assert clean_documents(odd, bench).count() == 7
    empty = bench.where("item_id = 9")
    assert overlaps(odd, empty).collect() == [] and clean_documents(odd, empty).count() == 10
    assert overlaps(frame([]), bench).collect() == []


def test_a_long_text_is_searched_to_its_end():
    s = Seeds([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi")])
    t = "filler word " * 50_000 + "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi"
    assert [x[0] for x in s.overlaps(t, 16, 0.8)] == [1]


@pytest.mark.parametrize("n", range(1, 16))
def test_short_items_survive_every_allowed_substitution(n):
    item = [f"w{i}" for i in range(n)]
    seeds = Seeds([(7, " ".join(item)), (8, "")])
    for lost in combinations(range(n), n // 5):
        text = " ".join(["so", *("other" if i in lost else w for i, w in enumerate(item)), "it"])
        assert [x[:3] for x in seeds.overlaps(text, 16, 0.8)] == [(7, n, n - len(lost))], lost
        assert bool(seeds.overlaps(text, 16, 0.8, 5)) == (n >= 5)
    for lost in combinations(range(n), n // 5 + 1):
        text = " ".join("other" if i in lost else w for i, w in enumerate(item))
        assert seeds.overlaps(text, 16, 0.8) == []


def test_items_without_spaces_are_searched():
    seeds = Seeds([(1, "今天天气很好"), (2, "你好,世界")])
    assert sorted(x[0] for x in seeds.overlaps("他说:今天天气很好。你好,世界!", 16, 0.8)) == [1, 2]
    # characters are words of their own there, so an item inside a longer run is found
    assert [x[0] for x in seeds.overlaps("因为今天天气很好所以我们出去", 16, 0.8)] == [1]
    assert words("ab 今天 cd9") == ["ab", "今", "天", "cd9"]


def test_a_phrase_that_many_items_share():
    rnd = random.Random(2)
    stem = "which of the following statements is true about the thing"
    items = [(i, f"{stem} {' '.join(f'q{rnd.randrange(9000)}' for _ in range(10))}") for i in range(20_000)]
    seeds = Seeds(items)
    text = " ".join(f"{stem} x{i} y{i} z{i}" for i in range(20)) + " " + items[77][1]
    began = time.process_time()
    got = seeds.overlaps(text, 16, 0.8)
    assert time.process_time() - began < 3  # 400,000 places
    assert [x[:3] for x in got if x[1] == 20] == [(77, 20, 20)]
    assert {x[0] for x in got} & set(range(0, 20_000, 500)) == brute(text, [items[i] for i in range(0, 20_000, 500)])


def test_batches_of_places_change_nothing(monkeypatch):
    from voxlab.llm import decontaminate as D
    docs, items, _ = planted()
    want = [Seeds([(i, t) for i, t in items]).overlaps(t, 16, 0.8) for _, t, *_ in docs]
    monkeypatch.setattr(D, "HITS", 3)
    monkeypatch.setattr(D, "COMPARED", 7)
    assert [Seeds([(i, t) for i, t in items]).overlaps(t, 16, 0.8) for _, t, *_ in docs] == want


def test_ids_of_other_types(spark, frame):
    text = "one two three four five six seven"
    for kind, value in (("date", datetime.date(2020, 1, 2)), ("double", 0.5), ("struct<a:int,b:string>", (1, "x"))):
        bench = spark.createDataFrame([(value, text)], f"item_id {kind}, text string")
        (r,) = overlaps(frame([(1, f"so {text} it", "en", "s")]), bench).collect()
        assert (tuple(r.item_id) if kind.startswith("struct") else r.item_id) == value and r.proves


def test_short_items_prove_nothing(spark, frame):
    bench = spark.createDataFrame([(1, "Yes")], "item_id int, text string")
    df = frame([(1, "well yes I think so", "en", "s")])
    assert [(r.item_id, r.proves) for r in overlaps(df, bench).collect()] == [(1, False)]
    assert clean_documents(df, bench).count() == 1
