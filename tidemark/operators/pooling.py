"""Mean and time-decayed pooling of id vectors.

Equal ids of an example are one entry with their weight before they meet their vectors. A table of vectors that
is small enough to be sent leaves the examples where they are; a larger one is
joined by a lookup that spreads hot ids. Vectors are added up by one aggregate with a single
buffer, combined map-side, so at most one row per example and task is shuffled. A table of few vectors can be
carried by the expression itself (``carried``): then a row's mean is a column, and no row is taken apart or moved.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.lookups import SENT_BYTES, counted_lookup

_ENTRIES = "array<struct<raw_id:bigint,w:double>>"
# Vectors that go along with every task of a plan, up to so many bytes.
CARRIED_BYTES = 1 << 20


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def counted(ids: Column) -> Column:
    """Entries ``(raw_id, w)``: how often each id that is not null occurs in the list, by one sort."""

    def runs(ids: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ids) - 1),
            lambda i: (i == 0) | (F.get(ids, i) != F.get(ids, i - 1)),
        )

        def entries(starts: Column) -> Column:
            return F.transform(
                starts,
                lambda at, k: F.struct(
                    F.get(ids, at).alias("raw_id"),
                    (F.coalesce(F.get(starts, k + 1), F.size(ids)) - at).cast("double").alias("w"),
                ),
            )

        return F.when(F.size(ids) > 0, _let(starts, entries)).otherwise(F.array().cast(_ENTRIES))

    known = F.filter(F.coalesce(ids.cast("array<bigint>"), F.array().cast("array<bigint>")), lambda x: x.isNotNull())
    return _let(F.sort_array(known), runs)


def _pool(
    lists: DataFrame,
    key: Sequence[str],
    vectors: DataFrame,
    dim: int,
    floor: float,
    most_bytes: int,
) -> DataFrame:
    """Sum of weight times vector over ``entries``, divided by ``total`` or ``floor``; unknown ids are zero vectors."""
    zero = array_to_vector(F.array_repeat(F.lit(0.0), dim))
    known = vectors.select("raw_id", array_to_vector(F.col("vector").cast("array<double>")).alias("_vector"))
    tokens = lists.select(*key, "total", F.explode_outer("entries").alias("_e")).select(
        *key, "total", "_e.raw_id", F.coalesce("_e.w", F.lit(0.0)).alias("w")
    )
    found = counted_lookup(
        tokens, known, "raw_id", {"_vector": F.lit(None).cast(VectorUDT())}, 8 * dim + 96, most_bytes, store=True
    )
    # The aggregate takes no weights of 0 alone: entries without effect are zero vectors of weight 1.
    counts = F.col("_vector").isNotNull() & (F.col("w") > 0)
    added = Summarizer.metrics("sum").summary(
        F.when(counts, F.col("_vector")).otherwise(zero), F.when(counts, F.col("w")).otherwise(F.lit(1.0))
    )
    sums = found.groupBy(*key).agg(added["sum"].alias("_sum"), F.first("total").alias("_total"))
    total = F.greatest("_total", F.lit(float(floor)))
    return sums.select(*key, F.transform(vector_to_array("_sum"), lambda x: x / total).alias("pooled"))


def embed_mean_pool(
    df: DataFrame,
    key: Sequence[str],
    column: str,
    vectors: DataFrame,
    dim: int,
    most_bytes: int = SENT_BYTES,
) -> DataFrame:
    """Mean vector over the non-zero ids of a list.

    Ids without a vector count in the denominator; a list without ids gives zeros.
    """
    ids = F.filter(F.col(column).cast("array<bigint>"), lambda x: x != 0)
    lists = df.select(*key, F.coalesce(F.size(ids), F.lit(0)).cast("double").alias("total"), counted(ids).alias("entries"))
    return _pool(lists, key, vectors, dim, 1.0, most_bytes)


@dataclass(frozen=True)
class Carried:
    """Few vectors as constants of an expression: ids and their vectors, by the home that an id's hash names.

    There are as many homes as ids, so looking one up takes as long at any size.
    """

    ids: Column
    vectors: Column
    homes: int


def _home(id_: Column, homes: int) -> Column:
    return F.pmod(F.xxhash64(id_), F.lit(homes).cast("long")).cast("int")


def carried(vectors: DataFrame, dim: int, most_bytes: int = CARRIED_BYTES) -> Carried | None:
    """The vectors for ``embed_mean`` and ``sequence_mean``; None if they take more than ``most_bytes`` or an id has several.

    They pass through the driver, as a table that is sent does. Constants are folded when a query is planned, so the text is read once;
    a column of them would be copied with every row.
    """
    size = vectors.agg(F.count("*").alias("rows"), F.count_distinct("raw_id").alias("ids")).first()
    if size["rows"] != size["ids"] or size["rows"] * (8 * dim + 96) > most_bytes:
        return None
    homes = max(1, size["rows"])
    raw_id = F.col("raw_id").cast("bigint")
    ids, found = [[] for _ in range(homes)], [[] for _ in range(homes)]
    known = vectors.select(_home(raw_id, homes).alias("home"), raw_id.alias("id"), F.col("vector").cast("array<double>").alias("v"))
    for home, id_, vector in known.collect():
        ids[home].append(id_)
        found[home].append(vector)
    constant = lambda x, of: F.from_json(F.lit(json.dumps(x)), of)
    return Carried(constant(ids, "array<array<bigint>>"), constant(found, "array<array<array<double>>>"), homes)


def _mean(ids: Column, table: Carried, dim: int) -> Column:
    """Sum of the vectors of ``ids`` over how many ids there are, 1 at least; unknown ids are zero vectors."""

    def mean(ids: Column) -> Column:
        at = F.transform(ids, lambda x: _home(x, table.homes))
        found = F.zip_with(
            ids, at, lambda x, h: F.get(F.get(table.vectors, h), (F.array_position(F.get(table.ids, h), x) - 1).cast("int"))
        )
        known = F.filter(found, lambda v: v.isNotNull())
        zero = F.array_repeat(F.lit(0.0), dim)
        added = F.aggregate(known, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
        total = F.greatest(F.size(ids).cast("double"), F.lit(1.0))
        return F.transform(added, lambda x: x / total)

    return _let(ids, mean)


def embed_mean(ids: Column, table: Carried, dim: int) -> Column:
    """``embed_mean_pool`` of the row's own list, by a ``carried`` table."""
    ids = F.coalesce(ids.cast("array<bigint>"), F.array().cast("array<bigint>"))
    return _mean(F.filter(ids, lambda x: x != 0), table, dim)


def sequence_mean(ids: Column, length: Column, table: Carried, dim: int) -> Column:
    """``sequence_mean_pool`` of the row's own list, by a ``carried`` table."""
    return _mean(_valid(ids, length), table, dim)


def _valid(ids: Column, length: Column) -> Column:
    """The entries before the length; a negative or null length has none."""
    ids = F.coalesce(ids.cast("array<bigint>"), F.array().cast("array<bigint>"))
    return F.slice(ids, F.lit(1), F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("int"))


def sequence_mean_pool(
    df: DataFrame,
    key: Sequence[str],
    column: str,
    length: str,
    vectors: DataFrame,
    dim: int,
    most_bytes: int = SENT_BYTES,
) -> DataFrame:
    """Mean vector over the positions before ``length``; at least 1 in the denominator."""
    ids = _valid(F.col(column), F.col(length))
    lists = df.select(*key, F.size(ids).cast("double").alias("total"), counted(ids).alias("entries"))
    return _pool(lists, key, vectors, dim, 1.0, most_bytes)


def decay_weight(bucket: Column, strength: float) -> Column:
    """Weight of an event by its recency bucket: 1 for the newest, falling with age."""
    return F.exp(F.lit(-float(strength)) * F.greatest(bucket - 1, F.lit(0)))


def time_decay_pool(
    df: DataFrame,
    key: Sequence[str],
    column: str,
    bucket: str,
    length: str,
    vectors: DataFrame,
    dim: int,
    strength: float,
    most_bytes: int = SENT_BYTES,
) -> DataFrame:
    """Mean vector weighted by recency over the positions before ``length``."""
    if strength <= 0:
        return sequence_mean_pool(df, key, column, length, vectors, dim, most_bytes)

    # A position without a bucket has no weight, whether its id is known or not.
    def weight(b: Column) -> Column:
        return F.when(b.isNotNull(), decay_weight(b, strength)).otherwise(F.lit(0.0))

    ids = _valid(F.col(column), F.col(length))
    weights = F.transform(ids, lambda x, i: weight(F.get(F.col(bucket), i)))
    entries = F.zip_with(ids, weights, lambda x, w: F.struct(x.alias("raw_id"), w.alias("w")))
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    lists = df.select(*key, total.alias("total"), entries.alias("entries"))
    return _pool(lists, key, vectors, dim, 1e-6, most_bytes)
