"""Traffic history of items: twelve features per item from (item_id, timestamp).

The chain is three aggregations, each decomposable and combined map-side:
(item, hour) -> (item, day) -> item. Hour rows carry all that days and items need, so
the log is shuffled once as counts, there is no join, and a hot item shrinks to one row
per hour before it moves. A log whose rows hardly share hours, too many for the session's
partitions, is dealt by item and day over more of them instead. Buckets are UTC.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.fixed_values import ITEM_HISTORY_NAMES, TRAILING_HOURS
from tidemark.functions.maths import log1p_nonneg, safe_ratio
from tidemark.functions.timefeat import floor_div
from tidemark.operators.filters import filter_time_range
from tidemark.operators.lookups import counted_lookup, shuffle_partitions


# An item with its values in an executor's hash table.
HISTORY_ROW_BYTES = 200
# Groups of one aggregation that a task holds, some 100 bytes each.
GROUPS_PER_TASK = 200_000


def last_timestamp(df: DataFrame) -> Column:
    """Newest timestamp of the log as a scalar subquery over that one column."""
    return df.agg(F.max("timestamp").alias("t")).scalar()


def _with_last(hours: DataFrame, max_ts: Column) -> DataFrame:
    """Hour rows with the newest time and its hour; the scalar is evaluated in one place."""
    return hours.withColumn("max_ts", max_ts).withColumn(
        "max_hour", floor_div(F.col("max_ts"), 3600)
    )


def _measured(log: DataFrame) -> Row:
    """About how many hour rows and items the log has, and its newest time, in one pass."""
    hour = floor_div(F.col("timestamp"), 3600)
    return log.agg(
        F.approx_count_distinct(F.xxhash64("item_id", hour)).alias("hours"),
        F.approx_count_distinct("item_id").alias("items"),
        F.max("timestamp").alias("newest"),
    ).first()


def _dealt(df: DataFrame, groups: int, *keys: str) -> DataFrame:
    """``df`` by its keys over as many tasks as the groups ask for, if the session has too few."""
    tasks = -(-groups // GROUPS_PER_TASK)
    return df.repartition(tasks, *keys) if tasks > shuffle_partitions(df) else df


def _hour_rows(df: DataFrame, groups: int) -> DataFrame:
    """``item_hour_counts`` with the day; later aggregations by item and day find the rows in place."""
    ts = F.col("timestamp")
    log = df.select("item_id", "timestamp", floor_div(ts, 86400).alias("day"))
    return _dealt(log, groups, "item_id", "day").groupBy("item_id", "day", floor_div(ts, 3600).alias("hour")).agg(
        F.count("*").alias("cnt"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    )


def item_hour_counts(df: DataFrame) -> DataFrame:
    """Rows, first and last time per (item, hour)."""
    log = df.select("item_id", "timestamp")
    return _hour_rows(log, _measured(log)["hours"]).drop("day")


def item_day_counts(df: DataFrame) -> DataFrame:
    """Rows and active hours per (item, day), from the hour counts."""
    hours = item_hour_counts(df)
    return hours.groupBy("item_id", floor_div(F.col("hour"), 24).alias("day")).agg(
        F.sum("cnt").alias("cnt"), F.count("*").alias("hours")
    )


def item_active_buckets(df: DataFrame) -> DataFrame:
    """Distinct active hours and days per item."""
    return item_day_counts(df).groupBy("item_id").agg(
        F.sum("hours").alias("active_hours"), F.count("*").alias("active_days")
    )


def item_core_stats(df: DataFrame) -> DataFrame:
    """Count, first and last time per item, and the newest time of the whole log."""
    return df.groupBy("item_id").agg(
        F.count("*").alias("cnt"),
        F.min("timestamp").alias("first_ts"),
        F.max("timestamp").alias("last_ts"),
    ).withColumn("max_ts", last_timestamp(df))


def _trailing(width: int) -> Column:
    in_window = F.col("hour") >= F.col("max_hour") - F.lit(width - 1)
    return F.sum(F.when(in_window, F.col("cnt")).otherwise(F.lit(0).cast("long")))


def item_trailing_counts(df: DataFrame) -> DataFrame:
    """Rows per item in the last 1, 6 and 24 hour buckets of the log."""
    hours = _with_last(item_hour_counts(df), last_timestamp(df))
    return hours.groupBy("item_id").agg(
        *[_trailing(w).alias(f"cnt_{w}h") for w in TRAILING_HOURS]
    )


def item_peak_ratio(df: DataFrame) -> DataFrame:
    """Share of an item's rows in its busiest hour."""
    return item_hour_counts(df).groupBy("item_id").agg(
        safe_ratio(F.max("cnt"), F.sum("cnt")).alias("peak_ratio")
    )


def _hours_between(later: Column, earlier: Column) -> Column:
    return F.greatest((later - earlier) / F.lit(3600.0), F.lit(0.0))


def _known(time: str) -> Column:
    """A time of exactly 0 stands for "unknown" and is read as the newest time."""
    return F.when(F.col(time) == 0, F.col("max_ts")).otherwise(F.col(time))


def item_alive_recency(df: DataFrame) -> DataFrame:
    """Hours between first and last row of an item, and since its last row."""
    first_ts, last_ts = _known("first_ts"), _known("last_ts")
    return item_core_stats(df).select(
        "item_id",
        _hours_between(last_ts, first_ts).alias("alive_hours"),
        _hours_between(F.col("max_ts"), last_ts).alias("recency_hours"),
    )


def item_trend(df: DataFrame) -> DataFrame:
    """Last hour's rows over the last day's."""
    return item_trailing_counts(df).select(
        "item_id", safe_ratio(F.col("cnt_1h"), F.col("cnt_24h")).alias("trend")
    )


def _entropy(total: Column, sum_c_ln_c: Column) -> Column:
    return F.greatest(F.ln(total) - sum_c_ln_c / total, F.lit(0.0))


def bucket_entropy(df: DataFrame) -> DataFrame:
    """Natural-log entropy of an item's rows over hours and over days."""
    days = item_hour_counts(df).groupBy(
        "item_id", floor_div(F.col("hour"), 24).alias("day")
    ).agg(F.sum("cnt").alias("cnt"), F.sum(F.col("cnt") * F.ln("cnt")).alias("h"))
    return days.groupBy("item_id").agg(
        _entropy(F.sum("cnt"), F.sum("h")).alias("hour_entropy"),
        _entropy(F.sum("cnt"), F.sum(F.col("cnt") * F.ln("cnt"))).alias("day_entropy"),
    )


def item_history(
    df: DataFrame,
    time_range: tuple[int | None, int | None] | None = None,
    as_of: Column | None = None,
) -> DataFrame:
    """The twelve-feature table, one row per item; an empty log gives an empty table.

    ``as_of`` is the time the trailing windows end at. By default it is the newest
    timestamp, taken in the pass over the log that also estimates its groups.
    """
    log = df.select("item_id", "timestamp")
    if time_range is not None:
        log = filter_time_range(log, *time_range)
    size = _measured(log)
    newest = F.lit(size["newest"]).cast(log.schema["timestamp"].dataType)
    hours = _with_last(_hour_rows(log, size["hours"]), newest if as_of is None else as_of)
    days = hours.groupBy("item_id", "day").agg(
        F.sum("cnt").alias("cnt"),
        F.count("*").alias("hours"),
        F.max("cnt").alias("peak"),
        F.sum(F.col("cnt") * F.ln("cnt")).alias("hour_h"),
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.max("max_ts").alias("max_ts"),
        *[_trailing(w).alias(f"cnt_{w}h") for w in TRAILING_HOURS],
    )
    items = _dealt(days, size["items"], "item_id").groupBy("item_id").agg(
        F.sum("cnt").alias("cnt"),
        F.sum("hours").alias("hours"),
        F.count("*").alias("days"),
        F.max("peak").alias("peak"),
        F.sum("hour_h").alias("hour_h"),
        F.sum(F.col("cnt") * F.ln("cnt")).alias("day_h"),
        F.min("first_ts").alias("first_raw"),
        F.max("last_ts").alias("last_raw"),
        F.max("max_ts").alias("max_ts"),
        *[F.sum(f"cnt_{w}h").alias(f"cnt_{w}h") for w in TRAILING_HOURS],
    )
    max_ts = F.col("max_ts")
    first_ts, last_ts = _known("first_raw"), _known("last_raw")
    values = (
        log1p_nonneg(F.col("cnt").cast("double")),
        log1p_nonneg(F.col("hours").cast("double")),
        F.col("days").cast("double"),
        safe_ratio(F.col("peak"), F.col("cnt")),
        log1p_nonneg(_hours_between(last_ts, first_ts)),
        log1p_nonneg(_hours_between(max_ts, last_ts)),
        log1p_nonneg(F.col("cnt_1h").cast("double")),
        log1p_nonneg(F.col("cnt_6h").cast("double")),
        log1p_nonneg(F.col("cnt_24h").cast("double")),
        safe_ratio(F.col("cnt_1h"), F.col("cnt_24h")),
        _entropy(F.col("cnt"), F.col("hour_h")),
        _entropy(F.col("cnt"), F.col("day_h")),
    )
    return items.select(
        "item_id", *[v.alias(n) for v, n in zip(values, ITEM_HISTORY_NAMES)]
    )


def attach_item_history(
    df: DataFrame, table: DataFrame, matched: str | None = None
) -> DataFrame:
    """Add the twelve features by item; items without history get twelve zeros.

    Build the table from whichever rows may be known to ``df`` and attach it anywhere.
    With ``matched`` a 0/1 column of that name tells whether the item was found.
    """
    fills = {n: F.lit(0.0) for n in ITEM_HISTORY_NAMES}
    if matched:
        table = table.withColumn(matched, F.lit(1))
        fills[matched] = F.lit(0)
    return counted_lookup(df, table, "item_id", fills, HISTORY_ROW_BYTES)


def history_vector() -> Column:
    """The twelve features as one array, in vector order."""
    return F.array(*[F.col(n) for n in ITEM_HISTORY_NAMES])


def coverage(df: DataFrame, matched: str) -> DataFrame:
    """Rows, rows with a hit, and their ratio."""
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col(matched) == 1).alias("matched_rows"),
        safe_ratio(F.count_if(F.col(matched) == 1), F.count("*")).alias("coverage"),
    )
