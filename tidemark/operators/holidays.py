"""Holiday marks from a calendar table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.fixed_values import DEFAULT_TZ_HOURS
from tidemark.functions.timefeat import local_day
from tidemark.operators.lookups import left_lookup


def holiday_lookup(
    df: DataFrame,
    holidays: DataFrame,
    first_day: str,
    last_day: str,
    column: str = "timestamp",
    tz_hours: float = DEFAULT_TZ_HOURS,
) -> DataFrame:
    """Add ``holiday``: 2 on a day listed in ``holidays(day date)``, 1 otherwise, 0 without time.

    The calendar is cut to ``first_day .. last_day`` and made distinct, so it has at most
    one row per day of that span.
    """
    lo, hi = dt.date.fromisoformat(first_day), dt.date.fromisoformat(last_day)
    days = (
        holidays.where(F.col("day").between(F.lit(lo), F.lit(hi)))
        .select(F.unix_date("day").cast("long").alias("_day"))
        .distinct()
        .withColumn("_listed", F.lit(2))
    )
    keyed = df.withColumn("_day", local_day(F.col(column), tz_hours))
    found = left_lookup(keyed, days, "_day", {"_listed": F.lit(1)})
    return found.select(
        *df.columns, F.when(F.col(column) > 0, F.col("_listed")).otherwise(0).alias("holiday")
    )
