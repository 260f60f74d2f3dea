"""Corpus pipeline: five filtering and mixing stages over the ``documents`` table.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written
as Parquet under the shared folder and read again as the next stage's ``docs``.
All stages but the last return the columns of ``documents``; the last returns one
row per copy that the mix takes, numbered in ``copy`` from 1, beside them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxlab.llm.common import prepare, stage, table
from voxlab.llm.decontaminate import clean_documents
from voxlab.llm.mixing import mixed_rows
from voxlab.llm.pii import redact
from voxlab.llm.quality import good_documents
from voxlab.llm.simhash import one_of_each


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking doesn't reject."""
    prepare(spark)
    return good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (4-word shingles, 4 bits)."""
    prepare(spark)
    return one_of_each(docs, words=4, distance=4)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    prepare(spark)
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    prepare(spark)
    return redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that bring the sources to their target weights."""
    prepare(spark)
    return mixed_rows(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("PII", pii_stage),
    ("mixing sources", mixing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the whole ``documents`` table."""
    prepare(spark)
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs


#: The learnt stages have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None
