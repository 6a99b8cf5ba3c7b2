"""Training and validation splits, shuffling, split sizes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ranking import SECOND_SHIFTS, value_at_rank
from tidemark.operators.storage import stored


def _split_points(
    df: DataFrame, valid_ratio: float, train_ratio: float, chunk_rows: int
) -> DataFrame:
    """One row: the positions at which training ends and validation starts.

    A chunk is ``chunk_rows`` consecutive rows of one file. Chunks are counted per file
    (the window runs over the file list), so the split is found without ranking rows.
    """
    per_file = df.groupBy("src_file").agg(
        (F.floor(F.max("src_row") / F.lit(chunk_rows)) + 1).alias("chunks")
    )
    before = Window.orderBy("src_file").rowsBetween(Window.unboundedPreceding, -1)
    files = per_file.withColumn("before", F.coalesce(F.sum("chunks").over(before), F.lit(0)))
    total = per_file.agg(F.sum("chunks").alias("n")).scalar()

    one = F.lit(1).cast("long")
    valid = (
        F.lit(0).cast("long")
        if valid_ratio <= 0
        else F.greatest(one, F.floor(total * F.lit(float(valid_ratio))))
    )
    valid_start = total - valid
    train_end = (
        F.greatest(one, F.floor(valid_start * F.lit(float(train_ratio))))
        if train_ratio < 1.0
        else valid_start
    )

    def point(chunk: Column) -> Column:
        here = (F.col("before") <= chunk) & (chunk < F.col("before") + F.col("chunks"))
        return F.max(
            F.when(
                here,
                F.struct(
                    F.col("src_file").alias("file"),
                    ((chunk - F.col("before")) * F.lit(chunk_rows)).alias("row"),
                ),
            )
        )

    return files.agg(
        F.struct(
            point(train_end).alias("train_end"), point(valid_start).alias("valid_start")
        ).alias("p")
    )


def split_by_position(
    df: DataFrame,
    valid_ratio: float = 0.1,
    train_ratio: float = 1.0,
    chunk_rows: int = 100_000,
    reference_compat: bool = False,
) -> DataFrame:
    """Add ``split``: the last ``max(1, int(chunks * valid_ratio))`` chunks validate.

    Needs ``src_file`` and ``src_row``. A ``valid_ratio`` of 0 trains on everything.
    ``train_ratio`` keeps the first part of the training chunks; the rows between are
    dropped, or validate as well under ``reference_compat``. Rows are compared with two
    positions held in a scalar subquery, so the data is neither sorted nor shuffled.
    """
    points = F.col("_points")
    df = df.withColumn(
        "_points", _split_points(df, valid_ratio, train_ratio, chunk_rows).scalar()
    )

    def is_before(p: Column) -> Column:
        file, row = F.col("src_file"), F.col("src_row")
        cut = p.getField("file")
        return (
            cut.isNull() | (file < cut) | ((file == cut) & (row < p.getField("row")))
        )

    train = is_before(points.getField("train_end"))
    gap = is_before(points.getField("valid_start"))
    if reference_compat:
        compat = F.when(train, "train").otherwise("valid")
        return df.withColumn("split", compat).drop("_points")
    split = F.when(train, "train").when(~gap, "valid")
    out = df.withColumn("split", split).drop("_points")
    return out.where(F.col("split").isNotNull()) if train_ratio < 1.0 else out


def time_cutoff(
    df: DataFrame, valid_ratio: float, column: str = "timestamp", sketch: bool = False
) -> DataFrame:
    """One row with the whole-second ``1 - valid_ratio`` quantile, linearly interpolated.

    Exact at any size: rows are counted per second in one pass over ``df``, the counts are stored, and
    ranks are found in them through cells, not by sorting. With ``sketch`` the cutoff is that of a
    quantile sketch: one pass without a shuffle of seconds, its rank within about 1.5 percent.
    """
    if sketch:
        made = df.agg(F.kll_sketch_agg_bigint(F.col(column).cast("bigint")).alias("s"))
        return made.select(F.kll_sketch_get_quantile_bigint("s", F.lit(1.0 - valid_ratio)).alias("cutoff"))
    ts = df.select(F.col(column).alias("ts")).where("ts is not null")
    ts = stored(ts.groupBy("ts").agg(F.count("*").alias("rows")))
    q = F.lit((1.0 - valid_ratio) * 100 / 100)
    n = ts.agg(F.coalesce(F.sum("rows"), F.lit(0))).scalar()
    low = value_at_rank(ts, "ts", F.floor((n - 1) * q), SECOND_SHIFTS, rows=F.col("rows")).scalar()
    around = ts.withColumn("low", low).agg(
        F.max("low").alias("low"),
        F.sum(F.when(F.col("ts") <= F.col("low"), F.col("rows")).otherwise(0)).alias("upto"),
        F.min(F.when(F.col("ts") > F.col("low"), F.col("ts"))).alias("next"),
        ((F.sum("rows") - 1) * q).alias("index"),
    )
    low, t = F.col("low"), F.col("index") - F.floor("index")
    # The value one rank further: still the same one when it occurs often enough.
    repeated = F.col("upto") > F.floor("index") + 1
    high = F.when(repeated, low).otherwise(F.coalesce(F.col("next"), low))
    step = (high - low).cast("double")
    value = F.when(t < 0.5, low + step * t).otherwise(high - step * (F.lit(1.0) - t))
    return around.select(value.cast("long").alias("cutoff"))


def split_by_time(
    df: DataFrame, valid_ratio: float = 0.1, column: str = "timestamp", sketch: bool = False
) -> DataFrame:
    """Add ``split``: rows up to the cutoff train, later rows validate; ``sketch`` as in ``time_cutoff``."""
    cutoff = time_cutoff(df, valid_ratio, column, sketch).scalar()
    return df.withColumn("split", F.when(F.col(column) <= cutoff, "train").otherwise("valid"))


def shuffle_examples(
    df: DataFrame, key: Sequence[str], seed: int, partitions: int, pass_no: int = 0
) -> DataFrame:
    """Rows in a seeded random order, spread evenly over ``partitions``.

    ``key`` should tell rows apart; ``pass_no`` gives each pass over the data its own
    order.
    """
    h = F.xxhash64(*[F.col(k) for k in key], F.lit(seed), F.lit(pass_no))
    return (
        df.withColumn("_order", h)
        .repartition(partitions, "_order")
        .sortWithinPartitions("_order", *key)
        .drop("_order")
    )


def split_sizes(
    df: DataFrame, batch_size: int, chunk_columns: Sequence[str] = ()
) -> DataFrame:
    """Rows and batches per split.

    ``batches`` is ``ceil(rows / batch_size)``. With ``chunk_columns``,
    ``batches_by_chunk`` rounds up within each chunk, an upper bound when batches do not
    cross chunks.
    """
    size = F.lit(batch_size)
    if not chunk_columns:
        return df.groupBy("split").agg(
            F.count("*").alias("rows"), F.ceil(F.count("*") / size).alias("batches")
        )
    chunks = df.groupBy("split", *chunk_columns).agg(F.count("*").alias("n"))
    return chunks.groupBy("split").agg(
        F.sum("n").alias("rows"),
        F.ceil(F.sum("n") / size).alias("batches"),
        F.sum(F.ceil(F.col("n") / size)).alias("batches_by_chunk"),
    )
