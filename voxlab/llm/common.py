"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxlab.session import ensure_checkpoint_dir, scratch_path, ship_package


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """A whole input table, or some of its columns."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def prepare(spark: SparkSession) -> None:
    """Shared scratch folder registered, package importable on the executors."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    Cuts the lineage: a lost executor costs the running stage only, and later
    readers get column pruning.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(id_col: Column) -> Column:
    """True where crc32(id as text) mod 3 is 1; a null id is not held out."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 == 1, F.lit(False))


def may_learn(id_col: Column) -> Column:
    """True where crc32(id as text) mod 3 is not 1; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 3 != 1, F.lit(False))


def chosen(id_col: Column, share: Column) -> Column:
    """A fixed pseudo-random subset holding about ``share`` of the ids."""
    return F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(1 << 30)) < share * (1 << 30)


def hash_share(id_col: Column, share: float) -> Column:
    """``chosen`` with one share for all."""
    return chosen(id_col, F.lit(share))
