"""Spark session and shared-folder helpers."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "voxlab", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the settings the operators assume.

    On a cluster ``master`` stays ``None`` and the launcher decides; locally
    pass ``local[N]``.  Shuffle partitions default to the number of cores for
    local runs; on a cluster set them from the data size (AQE coalesces).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names the folder.  Only where driver and executors are one
    process (a local master, as in tests) and nothing is configured, a fresh scratch
    folder is made; elsewhere executors couldn't see it, so a name is required.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        conf_dir = tempfile.mkdtemp(prefix="voxlab-ckpt-")
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint folder.

    Used for written intermediate tables and streaming checkpoints, so every
    executor (and a restarted driver) sees the same files.
    """
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/voxlab/{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df):
    """``df`` written as Parquet into the shared folder and read back.

    Unlike a row-based checkpoint, later readers read only the columns they
    use; a lost executor costs the running stage alone.  Column names and
    vector columns survive as they are.
    """
    path = scratch_path(df.sparkSession, "cut")
    with shuffles_removed(df.sparkSession):
        # a plan of its own, as a plan keeps what held when it was made
        df.select("*").write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._vx_cut = path
    return out


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What runs meanwhile leaves no shuffle files; else they stay on disk until the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def drop_cut(df) -> None:
    """Deletes the table of a frame that ``cut_lineage`` returned; nothing reads it any more."""
    sc, path = df.sparkSession.sparkContext, df._vx_cut
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


__all__ = ["get_spark", "ensure_checkpoint_dir", "scratch_path", "cut_lineage", "drop_cut", "ship_package"]


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``voxlab`` importable on the executors (``addPyFile`` of a zip).

    Pandas UDFs and grouped-map functions defined in the package are pickled
    by module reference, so Python workers must be able to import it.  On a
    cluster this is what ``--py-files`` does; here it is done once per
    SparkContext from the driver.
    """
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    out = os.path.join(tempfile.mkdtemp(prefix="voxlab-pkg-"), "voxlab.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg):
            if "__pycache__" in d:
                continue
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(out)
    _SHIPPED.add(key)
