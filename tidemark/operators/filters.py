"""Row filters and id checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import pad_int_list
from tidemark.schema import FeatureLayout


def filter_time_range(
    df: DataFrame, lo: int | None, hi: int | None, column: str = "timestamp"
) -> DataFrame:
    """Keep ``lo < ts <= hi``; either end may be open.

    The stored column is compared as it is, so the bounds reach the Parquet scan.
    """
    if lo is not None:
        df = df.where(F.col(column) > lo)
    if hi is not None:
        df = df.where(F.col(column) <= hi)
    return df


def _checked_columns(layout: FeatureLayout) -> list[tuple[str, str, int, int, bool]]:
    """(report group, column, vocabulary, kept length, is a list) of every int column."""
    out = []
    for group in ("user_int", "item_int"):
        for f in layout.group(group):
            out.append((group, f.column, f.vocab, f.length, f.length > 1))
    for d in layout.domains:
        for fid, vocab in d.fields:
            out.append((f"seq_{d.name}", d.column(fid), vocab, d.max_len, True))
    return [c for c in out if c[2] > 0]


def _at_least(bound: int) -> Callable[[Column], Column]:
    return lambda x: x >= bound


def oob_report(df: DataFrame, layout: FeatureLayout) -> DataFrame:
    """Out-of-range ids per column: how many, largest, smallest, and the vocabulary.

    One aggregation with three accumulators per column; no row is multiplied and
    nothing but one row per task is shuffled.
    """
    aggs, rows = [], []
    for i, (group, column, vocab, n, is_list) in enumerate(_checked_columns(layout)):
        c = F.col(column)
        if is_list:
            bad = F.filter(pad_int_list(c, n), _at_least(vocab))
            count, high, low = F.size(bad), F.array_max(bad), F.array_min(bad)
        else:
            bad = F.when(c >= vocab, c)
            count, high, low = bad.isNotNull().cast("int"), bad, bad
        aggs += [
            F.sum(count).alias(f"n{i}"),
            F.max(high).alias(f"hi{i}"),
            F.min(low).alias(f"lo{i}"),
        ]
        rows.append(
            F.struct(
                F.lit(group).alias("group"),
                F.lit(column).alias("column"),
                F.col(f"n{i}").alias("oob_count"),
                F.col(f"hi{i}").cast("long").alias("max_oob"),
                F.col(f"lo{i}").cast("long").alias("min_oob"),
                F.lit(vocab).cast("long").alias("vocab"),
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows))).where(F.col("oob_count") > 0)


def assert_in_vocab(df: DataFrame, layout: FeatureLayout) -> DataFrame:
    """Return ``df`` when every id is in range, else raise with count and range."""
    first = oob_report(df, layout).orderBy("group", "column").take(1)
    if first:
        r = first[0]
        raise ValueError(
            f"{r['group']} {r['column']}: {r['oob_count']} values out of range "
            f"[0, {r['vocab']}), actual [{r['min_oob']}, {r['max_oob']}]"
        )
    return df


def drop_nan_scores(df: DataFrame, score: str) -> DataFrame:
    """Rows whose score is a number."""
    return df.where(~F.isnan(F.col(score)))


def nan_score_count(df: DataFrame, score: str) -> DataFrame:
    """How many rows ``drop_nan_scores`` removes and keeps."""
    nan: Column = F.isnan(F.col(score))
    return df.agg(F.count_if(nan).alias("dropped"), F.count_if(~nan).alias("kept"))
