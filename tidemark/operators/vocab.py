"""Id vocabularies: sentences, frequencies, the top-k cut and the id mapping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.arrays import valid_tokens
from tidemark.operators.lookups import SENT_BYTES, counted_lookup
from tidemark.operators.ranking import ID_SHIFTS, first_rows_bound, value_at_rank
from tidemark.operators.storage import stored

# A dictionary entry in an executor's hash table.
VOCAB_ROW_BYTES = 96


def sentences(df: DataFrame, column: str, max_len: int | None = None) -> DataFrame:
    """Positive ids of each row, the first ``max_len`` if one is given, rows without any left out.

    A scalar column gives one-token sentences. Position columns are kept when present.
    """
    values = F.col(column)
    if not isinstance(df.schema[column].dataType, T.ArrayType):
        values = F.array(values)
    keep = [c for c in ("src_file", "src_row") if c in df.columns]
    return df.select(*keep, valid_tokens(values, max_len).alias("tokens")).where(
        F.size("tokens") > 0
    )


def limit_sentences(df: DataFrame, n: int) -> DataFrame:
    """First ``n`` rows in scan order, still spread over their partitions.

    The position of the n-th row is looked up first; the rows are then filtered in
    place instead of being sorted into one task.
    """
    cut = first_rows_bound(df, n).select(F.struct("cut_file", "cut_row")).scalar()
    # Structs compare field by field; there is no cut when the rows are fewer than n.
    return df.where(F.coalesce(F.struct("src_file", "src_row") <= cut, F.lit(True)))


def token_frequency(df: DataFrame, min_count: int = 5) -> DataFrame:
    """Occurrences of each token over all sentences, rare tokens dropped."""
    return (
        df.select(F.explode("tokens").alias("token"))
        .groupBy("token")
        .agg(F.count("*").alias("cnt"))
        .where(F.col("cnt") >= min_count)
    )


def top_k_vocab(freq: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent tokens (ties: smaller id) with ids 1..K in id order.

    The cut is found on the histogram of counts, and within the tied count by rank; ids come
    from range partitions. The counts are stored first: the cut reads them several times,
    the sentences are read once.
    """
    freq = stored(freq)
    by_count = Window.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    cut = (
        freq.groupBy("cnt")
        .agg(F.count("*").alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(by_count), F.lit(0)))
        .where((F.col("before") < k) & (F.col("before") + F.col("n") >= k))
        .select("cnt", (F.lit(k - 1) - F.col("before")).alias("_k"))
    )
    tied = freq.join(F.broadcast(cut), "cnt")
    last = value_at_rank(tied, "token", F.col("_k"), ID_SHIFTS, {"cut_cnt": F.col("cnt")})
    bound = last.select(F.struct(-F.col("cut_cnt"), "value")).scalar()
    # In the order "count down, id up"; there is no bound when tokens are fewer than k.
    kept = freq.where(F.coalesce(F.struct(-F.col("cnt"), "token") <= bound, F.lit(True)))
    return dense_ids(kept.withColumnRenamed("token", "raw_id")).select("raw_id", "compact_id", "cnt")


def dense_ids(df: DataFrame, column: str = "raw_id", name: str = "compact_id") -> DataFrame:
    """``df`` with the rank (from 1) of a unique column, without a sort in one task.

    The rows are dealt out by ranges of the column and stored; a row's rank is its rank in its
    partition plus the rows of the partitions before, of which there is one row each.
    """
    dealt = stored(df.repartitionByRange(column).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(column)) + F.col("_start")
    return dealt.join(F.broadcast(starts), "_part").withColumn(name, rank.cast("long")).drop("_part", "_start")


def compact_ids_many(
    df: DataFrame,
    key: Sequence[str],
    columns: Mapping[str, str],
    vocab: DataFrame,
    most_bytes: int = SENT_BYTES,
) -> DataFrame:
    """``key`` and every list of ``columns`` mapped to ids 1..K of its own feature, 0 otherwise.

    ``columns`` names the feature of each column; ``vocab`` has ``feature``, ``raw_id`` and
    ``compact_id`` of all of them. The elements of all columns are one set of rows that meets one
    dictionary, keyed by feature and raw id, and is put together again by one aggregation, so the
    number of passes does not grow with the columns. A null list gives an empty one. When ``df`` is already partitioned by a prefix of
    ``key`` and the dictionary is small enough to be sent, nothing is shuffled.
    """
    names = list(columns)
    element = "array<struct<column:int,pos:int,id:struct<feature:string,raw_id:bigint>>>"

    def elements(k: int, name: str) -> Column:
        def entry(x: Column, i: Column) -> Column:
            id_ = F.struct(F.lit(columns[name]).alias("feature"), x.alias("raw_id"))
            return F.struct(F.lit(k).alias("column"), i.cast("int").alias("pos"), id_.alias("id"))

        return F.coalesce(F.transform(F.col(name).cast("array<bigint>"), entry), F.array().cast(element))

    parts = [elements(k, name) for k, name in enumerate(names)]
    tokens = df.select(*key, F.explode_outer(F.concat(*parts)).alias("_e")).select(*key, "_e.column", "_e.pos", "_e.id")
    known = vocab.select(F.struct("feature", F.col("raw_id").cast("bigint").alias("raw_id")).alias("id"), "compact_id")
    found = counted_lookup(tokens, known, "id", {"compact_id": F.lit(0).cast("long")}, VOCAB_ROW_BYTES, most_bytes, store=True)

    def lists(k: int) -> Column:
        pairs = F.collect_list(F.when(F.col("column") == k, F.struct("pos", "compact_id")))
        return F.transform(F.sort_array(pairs), lambda p: p["compact_id"])

    return found.groupBy(*key).agg(*[lists(k).alias(name) for k, name in enumerate(names)])


def compact_ids(
    df: DataFrame,
    key: Sequence[str],
    column: str,
    vocab: DataFrame,
) -> DataFrame:
    """``key`` and the list mapped to ids 1..K by exact match, 0 otherwise; see ``compact_ids_many``."""
    one = vocab.select(F.lit(column).alias("feature"), "raw_id", "compact_id")
    return compact_ids_many(df, key, {column: column}, one)
