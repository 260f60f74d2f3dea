"""Registered queries of the training-data operators: name -> (spark, sf_dir) -> DataFrame, and oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)
        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_token_counts")
def token_counts(spark, sf_dir):
    """Tokens of every document under the word BPE vocabulary."""
    import public_tokenizers

    from .token_counts import count_tokens
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_mixing")
def mixing(spark, sf_dir):
    """Words taken of every document by the mix."""
    from .mixing import mix
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op9_topk", """
    WITH v AS (SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum([q.v[i] * c.v[i] FOR i IN range(1, len(q.v) + 1)]) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
    r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def topk(spark, sf_dir):
    """The five highest products of every fiftieth vector with all others."""
    from pyspark.sql import functions as F

    from .topk import top_k
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query("op10_simhash")
def simhash(spark, sf_dir):
    """Fingerprint and near-duplicate component of every document."""
    from .simhash import hex_fingerprint, near_duplicates
    rows = near_duplicates(table(spark, sf_dir, "documents"), words=4, distance=4)
    return rows.select("doc_id", hex_fingerprint(rows["fp"]).alias("fingerprint"), "component_id")


@query("op4_quality")
def quality(spark, sf_dir):
    """Quality score of every document."""
    from .quality import classify
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op5_langid")
def langid(spark, sf_dir):
    """Predicted language of every document."""
    from .langid import identify
    return identify(table(spark, sf_dir, "documents"))


@query("op6_lm_score")
def lm_score(spark, sf_dir):
    """Cross-entropy difference of every document: documents labelled good against all."""
    from .common import may_learn
    from .lm_score import cross_entropy_difference
    labels = table(spark, sf_dir, "labels")
    good = labels.where((labels["quality"] == 1) & may_learn(labels["doc_id"])).select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


@query("op2_decontaminate")
def decontaminate(spark, sf_dir):
    """Documents that hold benchmark passages, with the passages."""
    from .decontaminate import overlaps
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("proves", "contaminated")


@query("op8_html")
def html_text(spark, sf_dir):
    """Main text of every page."""
    from .html_extract import extract
    return extract(table(spark, sf_dir, "pages"))


@query("op3_pii")
def pii(spark, sf_dir):
    """Personal data in every document."""
    from .pii import find
    return find(table(spark, sf_dir, "documents"))


def _codes_sql(rounds: int = 4) -> str:
    """Rounds of assignment and mean over the parts of all vectors, in DuckDB SQL."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
    a{i} AS MATERIALIZED (SELECT p.vec_id, p.p, any_value(p.x) AS x, min({{'d': p.xx - 2 * list_inner_product(p.x, c.x) + c.cc, 'e': c.e}}) AS m
          FROM p JOIN (SELECT *, list_inner_product(x, x) AS cc FROM c{i}) c USING (p) GROUP BY p.vec_id, p.p)""")
        if i < rounds:
            steps.append(f"""
    m{i} AS (SELECT p, m.e AS e, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM a{i}),
    n{i} AS (SELECT p, e, list(x ORDER BY j) AS x FROM (SELECT p, e, j, floor(sum(x) / count(*)) AS x FROM m{i} GROUP BY p, e, j) GROUP BY p, e),
    c{i + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(n.x, c.x) AS x FROM c{i} c LEFT JOIN n{i} n ON n.p = c.p AND n.e = c.e)""")
    return f"""
    WITH v AS (SELECT vec_id, label, [floor(1024 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    p AS MATERIALIZED (SELECT *, list_inner_product(x, x) AS xx FROM (SELECT vec_id, label, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS x FROM v, range(4) r(p))),
    c0 AS (SELECT p, e, x FROM (SELECT p, x, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e FROM p) WHERE e < 256),
    {",".join(steps)},
    r AS (SELECT vec_id, string_agg(printf('%02x', CAST(m.e AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
    s AS (SELECT r.*, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error FROM r JOIN v USING (vec_id)),
    h AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256
          FROM (SELECT p, e, unnest(x) AS x, generate_subscripts(x, 1) AS j FROM c{rounds}))
    SELECT vec_id, code, error, label_error, codebooks_sha256 FROM s, h"""


@query("op13_vector_codes", _codes_sql())
def vector_codes(spark, sf_dir):
    """Product code and error of every vector."""
    from .vector_codes import compress
    return compress(table(spark, sf_dir, "embeddings"))[0]


@query("op11_token_alignment")
def token_alignment(spark, sf_dir):
    """Groups and links of the tokens of every document under two vocabularies."""
    import public_tokenizers

    from .token_alignment import align_documents
    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op12_minhash")
def minhash(spark, sf_dir):
    """Number of shingles and near-duplicate component of every document."""
    from .minhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), words=5, percent=85)
