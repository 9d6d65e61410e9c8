"""Session settings and the few checks that need a driver-side answer."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 64 << 20
_LOCAL: dict[str, str] = {}


def build_session(app: str = "lexstream", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators rely on; pass ``master`` for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def width(*text_cols: str) -> Column:
    """Rough bytes of a row, for size checks."""
    return sum((F.coalesce(F.length(F.col(c)), F.lit(0)) for c in text_cols), F.lit(0)) * 4 + 64


def hint(df: DataFrame, size: int | None, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast for a side of a known size; beyond the limit leave the join to Spark.

    There the join shuffles on its keys and adaptive execution splits skewed ones.
    """
    return F.broadcast(df) if (size or 0) <= limit else df


def small_side(df: DataFrame, *text_cols: str, limit: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``hint`` after counting the rows now."""
    return hint(df, df.agg(F.sum(width(*text_cols)).alias("n")).first()["n"], limit)


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL.get(spark.sparkContext.applicationId)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _LOCAL.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="lexstream-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Used for compiled dictionaries, which several joins read; a lost executor re-reads files instead of recomputing.
    The table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    """Remove a stored table when the driver ends, if its session still runs."""
    context = spark.sparkContext._jsc
    if context is not None and not context.sc().isStopped():
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(context.hadoopConfiguration()).delete(p, True)
