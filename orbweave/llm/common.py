"""Helpers shared by the text-corpus operators: table access and staging of intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in an Arrow batch handed to Python. Texts can be long, so batches are kept short.
BATCH_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of a dataset folder, read through Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Bound the rows that one Arrow batch brings into a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else (local runs only) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            folder = tempfile.mkdtemp(prefix="orbweave-")
        else:
            folder = spark.conf.get("spark.sql.warehouse.dir") + "/_staging"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and a lost executor costs nothing before it."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a table that ``stage`` wrote, once nothing reads it any more."""
    where = getattr(df, "_staged_at", None)
    if where:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have: ``name`` with underscores before it."""
    taken = {c.lower() for c in df.columns}
    name = f"_{name}"
    while any(c.startswith(name) for c in taken):
        name = f"_{name}"
    return name


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, row: str, top: int = 256) -> DataFrame:
    """Inner join on a non-negative bigint ``key`` that is unique in ``right``, where a few keys may hold most of ``left``.

    The ``top`` keys of largest ``weight`` are joined by broadcast (at most ``top`` rows), so no key left for the shuffle
    holds more than 1/top of the rows. ``row`` is a bigint of ``left`` that differs from row to row.
    """
    extra = [c for c in right.columns if c != key]
    hot = right.orderBy(F.desc(weight), key).limit(top).select(F.col(key).alias("_hot"), F.struct(*extra).alias("_hot_values"))
    cold = right.select(F.col(key).alias("_cold"), F.struct(*extra).alias("_cold_values"))
    met = left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    met = met.withColumn("_cold_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(-1 - F.abs(F.col(row))))
    met = met.join(cold, F.col("_cold_key") == F.col("_cold"), "left")
    return met.select(*left.columns, *[F.coalesce(F.col(f"_hot_values.{c}"), F.col(f"_cold_values.{c}")).alias(c) for c in extra])
