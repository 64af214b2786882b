"""Cutting lineage with tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local runs and one below the warehouse elsewhere."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        local = spark.sparkContext.master.split("[")[0] == "local"
        folder = tempfile.mkdtemp(prefix="orbweave-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_staging"
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write to the shared folder and read back; a lost executor then costs nothing that came before."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
