"""Exact ranks and running sums without a global sort in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# An id is cut into three digits; a window over one level sees at most 2**22 cells.
ID_SHIFTS = (42, 21, 0)
# Seconds: cells of about a day and a half, then single seconds.
SECOND_SHIFTS = (17, 0)
# Row numbers in a file.
ROW_SHIFTS = (20, 0)


def value_at_rank(
    df: DataFrame,
    value: str,
    rank: Column,
    shifts: Sequence[int],
    carry: Mapping[str, Column] | None = None,
    rows: Column | None = None,
) -> DataFrame:
    """One row holding the ``rank``-th smallest (from 0) value of a long column.

    Counts per leading digit come first (combined map-side), then only the cell that
    holds the rank is looked at again, one digit finer. Each window runs over the cells
    of one level, never over rows. No row comes out when the rank is past the end.

    ``rank`` and the ``carry`` columns are the same on every row of ``df``; the latter are
    handed on to the result. With ``rows``, a row of ``df`` stands for that many.
    """
    count = F.count("*") if rows is None else F.sum(rows)
    cells = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carry = dict(carry or {})
    scope, hit = df, None
    for level, shift in enumerate(shifts):
        if level:
            # One row, found by the level before.
            scope = df.join(
                F.broadcast(hit.select("_rest", F.col("cell").alias("_cell"))),
                F.shiftright(F.col(value), shifts[level - 1]) == F.col("_cell"),
            )
            rank = F.col("_rest")
        hit = (
            scope.groupBy(F.shiftright(F.col(value), shift).alias("cell"))
            .agg(
                count.alias("n"),
                F.max(rank).alias("k"),
                *[F.max(c).alias(name) for name, c in carry.items()],
            )
            .withColumn("before", F.coalesce(F.sum("n").over(cells), F.lit(0)))
            .where((F.col("before") <= F.col("k")) & (F.col("k") < F.col("before") + F.col("n")))
            .select("cell", (F.col("k") - F.col("before")).alias("_rest"), *carry)
        )
    return hit.select(F.col("cell").alias("value"), *carry)


def first_rows_bound(
    df: DataFrame, n: int, file: str = "src_file", row: str = "src_row"
) -> DataFrame:
    """One row ``(cut_file, cut_row)``: the ``n``-th row of ``df`` in scan order.

    Rows are counted per file; only the file that holds the n-th row is looked into.
    No row comes out when ``df`` has fewer than ``n`` rows.
    """
    files = Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        df.groupBy(file)
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(files), F.lit(0)))
        .where((F.col("before") < n) & (F.col("before") + F.col("n") >= n))
        .select(file, (F.lit(n - 1) - F.col("before")).alias("_k"))
    )
    in_file = df.select(file, row).join(F.broadcast(cut), file)
    found = value_at_rank(in_file, row, F.col("_k"), ROW_SHIFTS, {"cut_file": F.col(file)})
    return found.select("cut_file", F.col("value").alias("cut_row"))
