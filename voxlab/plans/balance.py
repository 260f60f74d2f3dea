"""Oversampling (J4 + M2) on the imbalanced stand-in: labels joined to documents.

minority = quality 0, majority = quality 1; features n_chars, toxic and the
source number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.neighbours import knn_self
from ..operators.sampling import hash_rank, smote
from ..sources.tables import read_table

FEATS = ["n_chars", "toxic", "src"]


def imbalanced_docs(spark: SparkSession, sf: str) -> DataFrame:
    lab = read_table(spark, sf, "labels")
    doc = read_table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    return lab.join(doc, "doc_id").select(
        "doc_id", F.col("quality").alias("status"), F.col("n_chars").cast("double").alias("n_chars"),
        F.col("toxic").cast("double").alias("toxic"), F.substring("source", 4, 10).try_cast("double").alias("src"))


def q_smote(spark: SparkSession, sf: str) -> DataFrame:
    s = smote(imbalanced_docs(spark, sf), "doc_id", FEATS, "status", minority=0, majority=1)
    return s.select("syn_id", "parent_doc_id", "nn_doc_id", "status", *[F.round(f, 6).alias(f) for f in FEATS])


def q_knn_minority(spark: SparkSession, sf: str) -> DataFrame:
    d = imbalanced_docs(spark, sf).where(F.col("status") == 0)
    d = hash_rank(d, "doc_id", [], 42, out="_rk", totals=False).drop("_vx_h")
    return knn_self(d, "doc_id", FEATS, k=5, order_key="_rk").select("doc_id", "nn_doc_id", F.col("pos").cast("long"), "dist2")


BASE_SQL = """
base AS (SELECT l.doc_id, l.quality AS status, CAST(d.n_chars AS DOUBLE) AS n_chars, CAST(l.toxic AS DOUBLE) AS toxic,
                CAST(substr(d.source, 4, 10) AS DOUBLE) AS src
         FROM labels l JOIN documents d USING (doc_id)),
mino AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR))), doc_id) AS rk
         FROM base WHERE status = 0),
cnt AS (SELECT count(*) FILTER (WHERE status = 0) AS n_min, count(*) FILTER (WHERE status = 1) AS n_maj FROM base),
prm AS (SELECT n_min, least(5, n_min - 1) AS kk, CAST(floor(n_maj * 0.25) AS BIGINT) - n_min AS n_new FROM cnt),
knn AS (SELECT * FROM (
          SELECT a.doc_id, b.doc_id AS nn_doc_id,
                 (a.n_chars - b.n_chars) * (a.n_chars - b.n_chars) + (a.toxic - b.toxic) * (a.toxic - b.toxic)
                 + (a.src - b.src) * (a.src - b.src) AS dist2,
                 row_number() OVER (PARTITION BY a.doc_id ORDER BY
                   (a.n_chars - b.n_chars) * (a.n_chars - b.n_chars) + (a.toxic - b.toxic) * (a.toxic - b.toxic)
                   + (a.src - b.src) * (a.src - b.src), b.rk) AS pos
          FROM mino a JOIN mino b ON a.doc_id <> b.doc_id)
        WHERE pos <= (SELECT kk FROM prm))"""

SQL_KNN_MINORITY = "WITH " + BASE_SQL + "\nSELECT doc_id, nn_doc_id, pos, dist2 FROM knn"


def _draw(tag: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', '42', '{tag}', CAST(j AS VARCHAR))), 1, 8))::BIGINT"


SQL_SMOTE = "WITH " + BASE_SQL + f""",
syn AS (SELECT j AS syn_id, ({_draw('p')} % n_min) + 1 AS prk, ({_draw('n')} % kk) + 1 AS pos,
               CAST({_draw('u')} AS DOUBLE) / 4294967296.0 AS u
        FROM prm, range((SELECT greatest(n_new, 0) FROM prm)) t(j))
SELECT s.syn_id, p.doc_id AS parent_doc_id, k.nn_doc_id, 0 AS status,
       round(p.n_chars + s.u * (nb.n_chars - p.n_chars), 6) AS n_chars,
       round(p.toxic + s.u * (nb.toxic - p.toxic), 6) AS toxic,
       round(p.src + s.u * (nb.src - p.src), 6) AS src
FROM syn s JOIN mino p ON p.rk = s.prk
JOIN knn k ON k.doc_id = p.doc_id AND k.pos = s.pos
JOIN mino nb ON nb.doc_id = k.nn_doc_id"""

QUERIES = {
    "smote": (q_smote, SQL_SMOTE),
    "knn_minority": (q_knn_minority, SQL_KNN_MINORITY),
}
