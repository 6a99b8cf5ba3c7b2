"""Statistics and scaling of dense vectors over observed positions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import DENSE_STD_FLOOR, UNSCALED_RANGES
from tidemark.functions.arrays import UNROLLED
from tidemark.functions.maths import signed_log1p
from tidemark.schema import transform_mask


def dense_stats(
    df: DataFrame,
    values: str,
    presence: str,
    log1p: bool = True,
    excluded: Sequence[tuple[int, int]] = UNSCALED_RANGES,
) -> DataFrame:
    """Per position: observed count, mean and population standard deviation.

    Absent positions do not count; excluded ranges get mean 0 and deviation 1. The
    exploded elements stay in their task: they are folded into at most one row per
    position there, and only those rows are shuffled.
    """
    observed = F.zip_with(values, presence, lambda x, p: F.when(p > 0, x))
    elements = df.select(F.posexplode(observed).alias("pos", "x"))
    scaled = transform_mask(F.col("pos"), excluded)
    x = F.when(scaled, signed_log1p(F.col("x")) if log1p else F.col("x"))
    stats = elements.groupBy("pos").agg(
        F.count(x).alias("count"),
        F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
        F.stddev_pop(x).alias("sd"),
    )
    degenerate = (F.col("count") <= 1) | (F.col("sd") < DENSE_STD_FLOOR) | F.col("sd").isNull()
    return stats.select(
        F.col("pos").cast("long").alias("pos"),
        "count",
        "mean",
        F.when(degenerate, F.lit(1.0)).otherwise(F.col("sd")).alias("std"),
    )


def stats_array(stats: DataFrame) -> Column:
    """The statistics as one array in position order: a scalar of layout size."""
    packed = F.sort_array(F.collect_list(F.struct("pos", "mean", "std")))
    return stats.agg(packed.alias("s")).scalar()


def _unrolled(values: str, presence: str, n: int, scale: Callable[[Column, Column], Column]) -> Column:
    """``scale`` of every observed position of lists that have ``n``, written out one by one."""
    each = [
        F.when(F.get(presence, F.lit(i)) > 0, scale(F.get(values, F.lit(i)), F.get("_stats", F.lit(i)))).otherwise(F.lit(0.0))
        for i in range(n)
    ]
    return F.array(*each)


def zscore_apply(
    df: DataFrame,
    values: str,
    presence: str,
    stats: DataFrame,
    log1p: bool = True,
    excluded: Sequence[tuple[int, int]] = UNSCALED_RANGES,
    dim: int | None = None,
) -> DataFrame:
    """``df`` with the masked-in positions of ``values`` scaled and absent ones back at 0.

    ``dim`` is the length that the lists usually have, if it is known: those are scaled faster.
    """

    def scale(x: Column, s: Column) -> Column:
        y = signed_log1p(x) if log1p else x
        z = (y - s["mean"]) / F.greatest(s["std"], F.lit(DENSE_STD_FLOOR))
        return F.when(transform_mask(s["pos"], excluded), z).otherwise(x)

    scaled = F.zip_with(values, "_stats", scale)
    kept = F.zip_with(scaled, presence, lambda z, p: F.when(p > 0, z).otherwise(F.lit(0.0)))
    if dim and dim <= UNROLLED:
        usual = (F.size(values) == dim) & (F.size(presence) == dim) & (F.size("_stats") == dim)
        kept = F.when(usual, _unrolled(values, presence, dim, scale)).otherwise(kept)
    return df.withColumn("_stats", stats_array(stats)).withColumn(values, kept).drop("_stats")
