"""Scans and sinks (IO1-IO13): CSV / JSON / Parquet, model persistence and
the append-only prediction log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C

LOG_SCHEMA = T.StructType([
    T.StructField("ts", T.TimestampType()), T.StructField("label", T.StringType()),
    T.StructField("input_type", T.StringType()), T.StructField("result", T.StringType()),
    T.StructField("p_positive", T.DoubleType()), T.StructField("confidence", T.DoubleType()),
])


def labelled_schema(feats: Sequence[str] = C.LABELLED_FEATURES) -> T.StructType:
    return T.StructType([T.StructField("name", T.StringType())] +
                        [T.StructField(f, T.DoubleType()) for f in feats[:16]] +
                        [T.StructField(C.LABEL_COL, T.IntegerType())] +
                        [T.StructField(f, T.DoubleType()) for f in feats[16:]])


def read_features(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """IO1: header CSV with an explicit schema (no inference pass)."""
    r = spark.read.option("header", True)
    return (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)


def read_longitudinal(spark: SparkSession, path: str, keep: Sequence[str] | None = None,
                      schema: T.StructType | None = None) -> DataFrame:
    """IO2: longitudinal CSV; extra columns tolerated, wanted ones selected by name.

    With ``schema`` (all columns of the file, in order) the file is read once; without it a first
    pass infers the types.
    """
    r = spark.read.option("header", True)
    df = (r.schema(schema) if schema is not None else r.option("inferSchema", True)).csv(path)
    return df.select(*[F.col(f"`{c}`") for c in keep]) if keep else df


def read_upload(spark: SparkSession, path: str) -> DataFrame:
    """IO3: ad-hoc upload, schema inferred (small files only)."""
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """IO4: multi-line JSON metrics document."""
    return spark.read.option("multiLine", True).json(path)


def write_metrics(df: DataFrame, path: str) -> None:
    """IO5: one-row metrics document as JSON (one part file)."""
    df.coalesce(1).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """IO6: header CSV export (parallel part files)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def save_pipeline(model, path: str) -> None:
    """IO7: fitted pipeline (scaler stage, assembler with the feature list,
    model), or the composite SVM model (its own writer)."""
    if hasattr(model, "write"):
        model.write().overwrite().save(path)
    else:
        model.save(path)


def load_pipeline(path: str, optional: bool = False, svm: bool = False):
    """IO8: load a fitted pipeline (or, with ``svm``, the composite SVM);
    with ``optional`` a failure gives None (the second bundle is optional)."""
    try:
        if svm:
            from ..operators.learn import PlattSVMModel
            return PlattSVMModel.load(path)
        return PipelineModel.load(path)
    except Exception as e:
        if optional and _absent(e):
            return None
        raise


def _absent(e: Exception) -> bool:
    """Whether a load failed as there is nothing at the path."""
    return any(x in str(e) for x in ("PATH_NOT_FOUND", "does not exist", "Input path does not exist", "FileNotFoundException"))


def save_bundle(spark: SparkSession, path: str, model, feats: Sequence[str], scaler: dict) -> None:
    """IO7: model, scaler constants and feature list as one bundle.

    The model is stored by its own writer beside a one-row table with the rest.
    """
    from ..operators.forest import GrownForestModel
    save_pipeline(model, f"{path}/model")
    kind = "spark" if hasattr(model, "write") else "forest" if isinstance(model, GrownForestModel) else "svm"
    spark.createDataFrame([(kind, list(feats), {k: float(v) for k, v in scaler.items()})],
                          "kind string, features array<string>, scaler map<string,double>") \
        .write.mode("overwrite").parquet(f"{path}/bundle")


def load_bundle(spark: SparkSession, path: str, optional: bool = False):
    """IO8: (model, features, scaler) of a saved bundle; None if ``optional`` and nothing is there."""
    from pyspark.ml.util import DefaultParamsReader

    from ..operators.forest import GrownForestModel
    from ..operators.learn import PlattSVMModel
    try:
        row = spark.read.parquet(f"{path}/bundle").first()
        own = {"svm": PlattSVMModel, "forest": GrownForestModel}.get(row["kind"])
        model = own.load(f"{path}/model") if own else DefaultParamsReader.loadParamsInstance(f"{path}/model", spark)
    except Exception as e:
        if optional and _absent(e):
            return None
        raise
    return model, list(row["features"]), dict(row["scaler"])


def cached(df: DataFrame) -> DataFrame:
    """IO9: memoise a frame that several steps read."""
    return df.persist()


def literal_rows(spark: SparkSession, rows, schema) -> DataFrame:
    """IO10: literal-row source."""
    return spark.createDataFrame(rows, schema)


def append_log(df: DataFrame, path: str) -> None:
    """IO11: append typed log rows, partitioned by day."""
    df.withColumn("log_date", F.to_date("ts")).write.mode("append").partitionBy("log_date").parquet(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(list(LOG_SCHEMA.fields) + [T.StructField("log_date", T.DateType())])
    return spark.read.schema(schema).parquet(path)


def clear_log(spark: SparkSession, path: str) -> None:
    """IO12: replace the log by an empty table of the same schema."""
    spark.createDataFrame([], LOG_SCHEMA).withColumn("log_date", F.to_date("ts")) \
        .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("log_date").parquet(path)


def preview(df: DataFrame, n: int = 10, order: Sequence[str] | None = None) -> DataFrame:
    """IO13 / K3: first n rows (by an explicit order when given)."""
    return (df.orderBy(*order) if order else df).limit(n)
