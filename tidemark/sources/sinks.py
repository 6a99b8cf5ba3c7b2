"""Writing examples and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.chunks import with_shards


def write_examples(
    df: DataFrame,
    path: str,
    shards: int | None = None,
    partition_by: str | None = "split",
) -> None:
    """Model-ready rows as Parquet, one directory per split.

    With ``shards`` the rows are dealt out evenly to that many files per split at most;
    without, every task writes what it has and nothing is shuffled.
    """
    if shards:
        df = df.repartition(shards)
    writer = df.write.mode("overwrite")
    if partition_by and partition_by in df.columns:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def write_balanced(df: DataFrame, path: str, shards: int, chunk_rows: int = 100_000) -> None:
    """One directory per shard (``shard=0``, …), with whole chunks of the scan and even numbers of rows.

    Rows are written by the task that read them; only the shards are chosen, by
    ``chunks.plan_shards``. Needs ``src_file`` and ``src_row``.
    """
    with_shards(df, shards, chunk_rows).write.mode("overwrite").partitionBy("shard").parquet(path)


def latest_predictions(scored: DataFrame) -> DataFrame:
    """One probability per user: that of the user's last row in scan order."""
    return scored.groupBy("user_id").agg(
        F.max_by("prob", F.struct("src_file", "src_row")).alias("prob")
    )


def write_predictions(scored: DataFrame, path: str) -> None:
    """``latest_predictions`` as JSON lines."""
    latest_predictions(scored).write.mode("overwrite").json(path)
