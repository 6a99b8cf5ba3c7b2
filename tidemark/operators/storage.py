"""Intermediate tables that several passes read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, else one below the shared warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    return named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"


def stored(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from reliable storage.

    For small results of a large pass that are needed several times: the pass is not
    repeated, also when executors are lost, and later plans stay short.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def packed(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """``df`` written as compressed columns in the shared folder and read back.

    For tables of whole examples: a checkpoint would keep their lists as they lie in memory,
    many times as large. ``schema`` reads columns as other types of the same storage, such as an ML vector
    from the struct behind it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/packed-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)
