"""Left lookups that stay balanced when a few keys hold most of the rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.storage import stored

# A key is heavy when it holds more than this fraction of one partition's fair share.
HEAVY_FRACTION = 0.5
# So many salts that hashing them to partitions leaves no partition far above the mean.
SALTS_PER_PARTITION = 32
# Rows of one partition of a shuffled lookup, above the session's number of partitions.
ROWS_PER_TASK = 1_000_000
# A table whose counted rows take no more than this is sent to every executor.
SENT_BYTES = 64 << 20


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def heavy_keys(df: DataFrame, key: str, share: float) -> DataFrame:
    """Keys holding more than ``share`` of the rows; at most ``1/share`` of them.

    The counts are combined map-side, so the hot keys cost one row per task.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("t")).scalar()
    return counts.where(F.col("_n") > total * F.lit(share)).select(key)


def row_salt(df: DataFrame, salts: int) -> Column:
    """A repeatable number per row, so that a retried task places its rows alike."""
    scalars = [
        f.name
        for f in df.schema.fields
        if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))
    ]
    return F.pmod(F.xxhash64(*scalars), F.lit(salts).cast("long"))


def left_lookup(
    df: DataFrame,
    table: DataFrame,
    key: str,
    fills: Mapping[str, Column],
    share: float | None = None,
) -> DataFrame:
    """Add columns of ``table`` (one row per key) to ``df``; unmatched rows get ``fills``.

    A matched row takes the values of the table as they are, nulls included. Both sides are
    shuffled on the key, except that the rows of heavy keys take their values from a
    broadcast of the at most ``1/share`` heavy table rows and are spread over all
    partitions by a salt instead of meeting in one. By default a key is heavy from half a partition's fair
    share on, so that broadcast is twice as many rows as there are partitions. Adaptive
    execution makes it a broadcast join where the measured table is small. The rows are counted first:
    too many for the session's partitions are dealt over more.
    """
    names = list(fills)
    tasks = -(-df.count() // ROWS_PER_TASK)
    partitions = max(tasks, shuffle_partitions(df))
    # Null keys never match. Saying so here keeps both uses of the table below the same
    # plan, so that its shuffles are reused.
    table = table.select(key, *names).where(F.col(key).isNotNull())
    heavy = heavy_keys(df, key, share or HEAVY_FRACTION / partitions)
    # An inner join: a semi join would be pushed below the aggregations the table comes
    # from, and the table would be computed twice instead of its last shuffle being reused.
    heavy_hits = table.join(F.broadcast(heavy), key).withColumn("_found_heavy_", F.lit(True))
    heavy_rows = heavy.join(F.broadcast(heavy_hits), key, "left").select(
        key,
        F.lit(True).alias("_heavy"),
        "_found_heavy_",
        *[F.col(n).alias(f"_heavy_{n}") for n in names],
    )
    spread = df.join(F.broadcast(heavy_rows), key, "left").withColumn(
        "_salt",
        F.when(
            F.col("_heavy") | F.col(key).isNull(), row_salt(df, SALTS_PER_PARTITION * partitions) + 1
        ).otherwise(F.lit(0).cast("long")),
    )
    # Zero, but not a literal: a constant join key would be taken out of the shuffle, and
    # the salted rows would meet in one task after all. A hash is never null, so no null
    # check of it is pushed into the plan of the table.
    plain = table.withColumn("_salt", F.xxhash64(key).bitwiseAND(F.lit(0).cast("long")))
    if tasks > shuffle_partitions(df):
        spread, plain = (side.repartition(tasks, key, "_salt") for side in (spread, plain))
    joined = spread.join(plain.withColumn("_found_", F.lit(True)), [key, "_salt"], "left")
    return joined.select(
        *df.columns,
        *[
            F.when(F.col("_found_"), F.col(n))
            .when(F.col("_found_heavy_"), F.col(f"_heavy_{n}"))
            .otherwise(fills[n])
            .alias(n)
            for n in names
        ],
    )


def counted_lookup(
    df: DataFrame,
    table: DataFrame,
    key: str,
    fills: Mapping[str, Column],
    row_bytes: int,
    most_bytes: int = SENT_BYTES,
    store: bool = False,
) -> DataFrame:
    """``left_lookup`` that counts the table's rows first.

    The table is stored, as it is read for the count and for the join. Up to ``most_bytes`` it is sent to the
    executors: the rows of ``df`` stay where they are and the plan behind them runs once. A larger
    table takes the way of ``left_lookup``, which reads ``df`` for the key counts as well;
    ``store`` has ``df`` written once for both reads.
    """
    names = list(fills)
    table = stored(table.select(key, *names).where(F.col(key).isNotNull()))
    if table.count() * row_bytes > most_bytes:
        return left_lookup(stored(df) if store else df, table, key, fills)
    known = table.select(F.col(key).alias("_key_"), F.lit(True).alias("_found_"), *[F.col(n).alias(f"_{n}_") for n in names])
    joined = df.join(F.broadcast(known), F.col(key) == F.col("_key_"), "left")
    return joined.select(
        *df.columns, *[F.when(F.col("_found_"), F.col(f"_{n}_")).otherwise(fills[n]).alias(n) for n in names]
    )
