import random

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from voxlab.llm.decontaminate import words
from voxlab.llm.quality import classify
from voxlab.session import ensure_checkpoint_dir

from .test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"


def test_registered():
    names = list(entry.queries())
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10
    assert set(entry.oracle_sql()) <= set(names)


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """documents, labels and benchmark with planted cases."""
    ensure_checkpoint_dir(spark)
    rnd = random.Random(12)
    vocab = ["the", "of", "and", "to", *["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randrange(3, 8))) for _ in range(500)]]
    prose = lambda n: " ".join(rnd.choice(vocab[:4]) if rnd.random() < 0.3 else rnd.choice(vocab) for _ in range(n)).capitalize() + "."
    bench = [(i, prose(rnd.randrange(20, 40))) for i in range(10)]
    docs, labels = [], []
    for i in range(240):
        t, kind = prose(rnd.randrange(40, 160)), i % 12
        if kind == 1:
            t = "!! ".join(t.upper().split()) + " ### $$$ | |"
        if kind == 2:
            t = docs[-2][1]
        if kind == 3:
            t = t + " " + rnd.choice(bench)[1] + " " + prose(20)
        if kind == 4:
            t = t + f" write to a{i}@host.org now"
        docs.append((i, t, "en", f"s{i % 5}" if i % 7 else None, len(t)))
        if i % 2 or kind == 4:
            labels.append((i, int(kind != 1), 0))
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, bench


def test_stages_against_brute_force(spark, inputs):
    d, docs, bench = inputs
    cols = ["doc_id", "text", "lang", "source", "n_chars"]
    df = spark.read.parquet(f"{d}/documents.parquet")
    kept = {i for i, *_ in docs}
    for (name, step), k in zip(corpus_pipeline.STAGES, range(5), strict=True):
        before = {r.doc_id: r.text for r in df.collect()}
        out = step(spark, df, d)
        rows = out.collect()
        after = {r.doc_id: r.text for r in rows}
        if k < 4:
            assert out.columns == cols and len(rows) == len(after)
        if k == 0:
            want = {r.doc_id for r in classify(df, spark.read.parquet(f"{d}/labels.parquet")).collect() if r.predicted}
            assert set(after) == want and not any(i % 12 == 1 for i in after) and len(after) >= 215
        if k == 1:
            ids = sorted(before)
            group = brute_components([brute_fingerprint(before[i]) for i in ids])
            assert set(after) == {ids[g] for g in set(group)} and not any(i % 12 == 2 for i in after)
        if k == 2:
            held = {i for i, t in before.items() if any(f" {' '.join(words(b))} " in f" {' '.join(words(t))} " for _, b in bench)}
            assert set(after) == set(before) - held and held
        if k == 3:
            assert set(after) == set(before)
            assert all(("[EMAIL]" in t) == (i % 12 == 4) and "@host" not in t for i, t in after.items())
            assert all(r.n_chars == len(r.text) for r in rows)
        if k == 4:
            copies = {}
            for r in rows:
                copies[r.doc_id] = max(copies.get(r.doc_id, 0), r.copy)
                assert r.text == before[r.doc_id]
            assert sum(copies.values()) == len(rows) and max(copies.values()) <= 3
            by, got = {}, {}
            for r in df.collect():
                n = len(r.text.split())
                by[r.source] = by.get(r.source, 0) + n
                got[r.source] = got.get(r.source, 0) + n * copies.get(r.doc_id, 0)
            order = sorted(s for s in by if s is not None) + [None]
            total, weight = sum(by.values()), {s: 1 + i % 3 for i, s in enumerate(order)}
            for s in order:
                want = total * weight[s] / sum(weight.values())
                if all(total * weight[x] / sum(weight.values()) <= 3 * by[x] for x in order):
                    assert abs(got[s] - want) <= 170
        df = spark.createDataFrame(rows, out.schema) if rows else out
        kept &= set(after)
    assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == set(after)


def test_stages_over_odd_rows(spark, odd, inputs):
    d, _, _ = inputs
    docs = odd
    for k, (_, step) in enumerate(corpus_pipeline.STAGES):
        out = step(spark, odd, d)
        assert out.columns == odd.columns + (["copy"] if k == 4 else [])
        out.collect()
        assert step(spark, docs.where("doc_id = -1"), d).collect() == []
