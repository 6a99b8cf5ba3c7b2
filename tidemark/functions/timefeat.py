"""Calendar, day-type and recency ids from Unix seconds.

Only integer arithmetic, a constant table and balanced CASE trees: no time zone of the
session is involved. The bodies are kept to a few operations because Spark interprets
them element by element when they are applied to lists.
"""

from __future__ import annotations

import datetime as dt
import math
from bisect import bisect_right
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.fixed_values import (
    DAY_PERIOD_EDGES,
    DEFAULT_TZ_HOURS,
    HOLIDAYS,
    RECENCY_EDGES,
)
from tidemark.functions.arrays import fill_to

_EPOCH = dt.date(1970, 1, 1)
_EPOCH_WEEKDAY = 3  # a Thursday, Monday being 0
_HOUR, _DAY, _WEEK = 3600, 86400, 7 * 86400
# Older than any age: what a missing event time is turned into.
_NO_AGE = -(2**62)


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


def _zone_seconds(tz_hours: float) -> int:
    return int(round(tz_hours * 3600))


def floor_div(value: Column, step: int) -> Column:
    """Integer division rounding down, for negative values too."""
    return F.call_function("div", value - F.pmod(value, _long(step)), _long(step))


def bin_index(value: Column, edges: Sequence[int], closed: str) -> Column:
    """How many edges lie below ``value``, by a balanced tree of comparisons.

    ``closed='right'`` leaves a value equal to an edge in the bin below it,
    ``closed='left'`` puts it in the bin above.
    """

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        above = value > edges[mid] if closed == "right" else value >= edges[mid]
        return F.when(above, tree(mid + 1, hi)).otherwise(tree(lo, mid))

    return tree(0, len(edges))


def local_day(ts: Column, tz_hours: float = DEFAULT_TZ_HOURS) -> Column:
    """Days since 1970-01-01 in the given zone."""
    return floor_div(ts + _long(_zone_seconds(tz_hours)), _DAY)


def _calendar_table() -> Column:
    """The ids of the 168 hours of a week that starts like the epoch, after an all-zero entry."""
    rows = ["named_struct('hour', 0, 'weekday', 0, 'period', 0)"]
    for i in range(7 * 24):
        hour, weekday = i % 24, (i // 24 + _EPOCH_WEEKDAY) % 7
        period = bisect_right(DAY_PERIOD_EDGES, hour)
        rows.append(
            f"named_struct('hour', {hour + 1}, 'weekday', {weekday + 1}, 'period', {period + 1})"
        )
    return F.expr(f"array({', '.join(rows)})")


def calendar_ids(ts: Column, tz_hours: float = DEFAULT_TZ_HOURS) -> Column:
    """Struct of hour 1..24, weekday Monday=1..7 and day period 1..6; zeros when ts <= 0."""
    second_of_week = F.pmod(ts + _long(_zone_seconds(tz_hours)), _long(_WEEK))
    hour_of_week = F.call_function("div", second_of_week, _long(_HOUR)) + 1
    return F.get(_calendar_table(), F.when(ts > 0, hour_of_week).otherwise(0).cast("int"))


def day_type(
    ts: Column,
    tz_hours: float = DEFAULT_TZ_HOURS,
    holidays: Sequence[str] = HOLIDAYS,
) -> Column:
    """Struct of weekend and holiday marks: 0 padding, 1 no, 2 yes."""
    zone = _zone_seconds(tz_hours)
    # Counted from Monday of the epoch's week.
    second_of_week = F.pmod(ts + _long(zone + _EPOCH_WEEKDAY * _DAY), _long(_WEEK))
    # One day is added so that local times before the epoch, possible in western zones
    # on its first day, do not round towards zero.
    day = F.call_function("div", ts + _long(zone + _DAY), _long(_DAY))
    listed = [(dt.date.fromisoformat(d) - _EPOCH).days + 1 for d in holidays]

    def marks(weekend: Column, holiday: Column) -> Column:
        return F.struct(weekend.alias("weekend"), holiday.alias("holiday"))

    return F.when(
        ts > 0,
        marks(
            F.when(second_of_week >= 5 * _DAY, 2).otherwise(1),
            F.when(day.isin(listed), 2).otherwise(1),
        ),
    ).otherwise(marks(F.lit(0), F.lit(0)))


def _each(ts_list: Column, pad_to: int | None, of: Callable[[Column], Column]) -> Column:
    """``of`` for every timestamp; padding is what ``of`` gives for a missing time."""
    out = F.transform(ts_list, of)
    if pad_to is None:
        return out
    return fill_to(out, pad_to, of(_long(0)), F.size(ts_list))


def calendar_ids_seq(
    ts_list: Column, tz_hours: float = DEFAULT_TZ_HOURS, pad_to: int | None = None
) -> Column:
    """``calendar_ids`` of every entry of a timestamp list, on demand padded with zeros."""
    return _each(ts_list, pad_to, lambda t: calendar_ids(t, tz_hours))


def day_type_seq(
    ts_list: Column,
    tz_hours: float = DEFAULT_TZ_HOURS,
    holidays: Sequence[str] = HOLIDAYS,
    pad_to: int | None = None,
) -> Column:
    """``day_type`` of every entry of a timestamp list, on demand padded with zeros."""
    return _each(ts_list, pad_to, lambda t: day_type(t, tz_hours, holidays))


def _age(now: Column, ts: Column) -> Column:
    return F.when(ts != 0, now - ts).otherwise(_long(_NO_AGE))


def _age_bin(age: Column) -> Column:
    # A missing time is below the first edge, hence bin 0. Ages below 0 share the first
    # real bin. The last edge is left out: ages past it share the last bin.
    return bin_index(age, (_NO_AGE // 2, *RECENCY_EDGES[:-1]), closed="right")


def recency_bucket(now: Column, ts: Column) -> Column:
    """Age bin 1..63 of one event; 0 only for a timestamp of exactly 0 or null."""
    return _age_bin(_age(now, ts))


def recency_bucket_seq(now: Column, ts_list: Column, pad_to: int | None = None) -> Column:
    """``recency_bucket`` of every entry of a timestamp list, on demand padded with zeros."""
    # Two passes, so that the tree compares a ready age instead of computing it at every node.
    ages = F.transform(ts_list, lambda t: _age(now, t))
    bins = F.transform(ages, _age_bin)
    return bins if pad_to is None else fill_to(bins, pad_to, F.lit(0), F.size(ts_list))


def cyclical_time(hour: Column, weekday: Column) -> Column:
    """Sine and cosine of hour and weekday as four values, zeros when the time is missing."""
    hour_angle = F.greatest(hour - 1, F.lit(0)) * F.lit(2.0 * math.pi / 24.0)
    week_angle = F.greatest(weekday - 1, F.lit(0)) * F.lit(2.0 * math.pi / 7.0)
    parts = (F.sin(hour_angle), F.cos(hour_angle), F.sin(week_angle), F.cos(week_angle))
    return F.array(*[F.when(hour > 0, p).otherwise(F.lit(0.0)) for p in parts])
