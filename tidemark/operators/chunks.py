"""Scan order: places of rows over all files, balanced shards, shuffling inside windows."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.lookups import counted_lookup

#: Bytes that one row of the file list is reckoned at.
FILE_BYTES = 300


def file_list(df: DataFrame, chunk_rows: int = 1) -> DataFrame:
    """One row per file: ``rows``, its whole chunks ``full``, the rows ``rest`` after them.

    ``before`` and ``full_before`` are the rows and whole chunks of all files before it. Positions
    count, so rows that were filtered out keep their places. The window runs over the file list.
    """
    rows = df.groupBy("src_file").agg((F.max("src_row") + 1).alias("rows"))
    rows = rows.select(
        "src_file",
        "rows",
        F.floor(F.col("rows") / F.lit(chunk_rows)).alias("full"),
        (F.col("rows") % chunk_rows).alias("rest"),
    )
    before = Window.orderBy("src_file").rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    return rows.withColumn("before", upto("rows")).withColumn("full_before", upto("full"))


def _dealt(shards: int, chunk_rows: int):
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loads = None
        for batch in batches:
            if loads is None:
                whole = int(batch["whole"].iloc[0]) if len(batch) else 0
                each, more = divmod(whole, shards)
                loads = [((each + (k < more)) * chunk_rows, k) for k in range(shards)]
                heapq.heapify(loads)
            found = []
            for rest in batch["rest"]:
                load, k = loads[0]
                heapq.heapreplace(loads, (load + int(rest), k))
                found.append(k)
            yield pd.DataFrame({"src_file": batch["src_file"], "rest_shard": found})

    return deal


def plan_shards(df: DataFrame, shards: int, chunk_rows: int = 100_000) -> DataFrame:
    """Which shard holds which chunk: ``(src_file, full_before, full, rest, rest_shard)``, one row per file.

    Chunks are taken largest first, equal ones in scan order, and each goes to the shard with the
    fewest rows, the lowest of several. Whole chunks are all equal and come first, so they go round
    the shards, and only the shorter chunk at a file's end is dealt one after the other: a list of
    one row per file passes through one task, with ``shards`` sums as its state.
    """
    files = file_list(df, chunk_rows)
    whole = files.agg(F.sum("full").alias("n")).scalar()
    ends = files.where("rest > 0").select("src_file", "rest", whole.alias("whole"))
    dealt = (
        ends.repartition(1)
        .sortWithinPartitions(F.desc("rest"), "src_file")
        .mapInPandas(_dealt(shards, chunk_rows), "src_file string, rest_shard long")
    )
    return files.join(dealt, "src_file", "left").select(
        "src_file", "full_before", "full", "rest", "rest_shard"
    )


def with_shards(df: DataFrame, shards: int, chunk_rows: int = 100_000) -> DataFrame:
    """Add ``shard``, by ``plan_shards``; rows stay in their tasks as long as the file list is small.

    Needs ``src_file`` and ``src_row``.
    """
    plan = plan_shards(df, shards, chunk_rows).select(
        "src_file", F.struct("full_before", "full", "rest_shard").alias("_plan")
    )
    rows = counted_lookup(df, plan, "src_file", {"_plan": F.lit(None)}, FILE_BYTES)
    chunk, p = F.floor(F.col("src_row") / F.lit(chunk_rows)), F.col("_plan")
    whole = (p.getField("full_before") + chunk) % shards
    shard = F.when(chunk < p.getField("full"), whole).otherwise(p.getField("rest_shard"))
    return rows.withColumn("shard", shard).drop("_plan")


def shuffle_in_windows(
    df: DataFrame, batch_rows: int, seed: int, window_batches: int = 20, pass_no: int = 0
) -> DataFrame:
    """Add ``batch`` and ``place``: rows in a random order that never leaves a window of the scan.

    A window is ``window_batches`` batches of consecutive positions, so a reader in scan order needs no
    more than one window at a time. Each window has its own seed, ``seed`` plus its number, and
    ``pass_no`` gives each pass its own order. The order rests on positions only, so a task that
    runs again gives the same. Windows are of bounded size, so no group grows with the input.
    """
    files = file_list(df).select("src_file", F.col("before").alias("_before"))
    rows = counted_lookup(df, files, "src_file", {"_before": F.lit(None)}, FILE_BYTES)
    at, width = F.col("_before") + F.col("src_row"), batch_rows * window_batches
    rows = rows.withColumn("_at", at).withColumn("_window", F.floor(at / F.lit(width)))
    key = F.md5(F.concat_ws(":", F.col("_window") + seed, F.lit(pass_no), F.col("_at")).cast("binary"))
    order = Window.partitionBy("_window").orderBy("_key", "_at")
    placed = rows.withColumn("_key", key).withColumn("_rank", F.row_number().over(order) - 1)
    return placed.select(
        *df.columns,
        (F.col("_window") * window_batches + F.floor(F.col("_rank") / F.lit(batch_rows))).alias("batch"),
        (F.col("_rank") % batch_rows).cast("bigint").alias("place"),
    )
