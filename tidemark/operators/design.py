"""Sparse design rows: one-hot, hashed, pooled and dense columns side by side, as ML vectors.

Everything is a Column, so the vectors are made in the JVM in the projection that builds the
examples. A row has as many entries as it has distinct ids, whatever the width of the design.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.fixed_values import DEFAULT_HASH_BUCKETS, DEFAULT_HASH_THRESHOLD
from tidemark.functions.arrays import UNROLLED
from tidemark.functions.ids import hash_bucket
from tidemark.operators.storage import packed
from tidemark.schema import FeatureLayout, route_by_cardinality

_PARTS = "array<struct<i:int,v:double>>"
_VECTOR = T.StructType([T.StructField("v", VectorUDT())])


@dataclass(frozen=True)
class Block:
    """Consecutive columns of the design that belong to one feature.

    ``group`` is a feature group or the name of a sequence domain. One-hot and hashed blocks
    have a column per id from 0 on; that of id 0, which pads, stays empty.
    """

    group: str
    fid: int
    route: str
    offset: int
    width: int

    @property
    def pooled(self) -> str:
        """The column that holds the pooled vector of a ``word2vec`` block."""
        return f"{self.group}_{self.fid}_pooled"


def design_width(blocks: Sequence[Block]) -> int:
    return blocks[-1].offset + blocks[-1].width if blocks else 0


def plan_design(
    spark: SparkSession,
    layout: FeatureLayout,
    hash_threshold: int = DEFAULT_HASH_THRESHOLD,
    hash_buckets: int = DEFAULT_HASH_BUCKETS,
    word2vec: Sequence[tuple[str, int]] = (),
    vector_dim: int = 0,
) -> tuple[Block, ...]:
    """The blocks of a layout: ids by the route their cardinality asks for, then dense groups.

    A vocabulary of size n has a column for each of 0..n, as calendar ids reach n. Features
    without a vocabulary are left out unless they are pooled.
    """
    entries = [(f.group, f.fid, f.vocab) for f in layout.features if f.group.endswith("_int")]
    entries += [(d.name, fid, vocab) for d in layout.domains for fid, vocab in d.fields]
    blocks: list[Block] = []
    if entries:
        declared = spark.createDataFrame(entries, "group string, fid long, vocab long")
        routed = route_by_cardinality(declared, hash_threshold, hash_buckets, word2vec)
        route = {(r["group"], r["fid"]): r["route"] for r in routed.collect()}
        for group, fid, vocab in entries:
            how = route[group, fid]
            width = {"direct": vocab + 1, "hash": hash_buckets + 1, "word2vec": vector_dim, "skip": 0}[how]
            if width:
                blocks.append(Block(group, fid, how, design_width(blocks), width))
    for group in ("user_dense", "item_dense"):
        if width := layout.total_dim(group):
            blocks.append(Block(group, 0, "dense", design_width(blocks), width))
    return tuple(blocks)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), body)[0]


def counted_ids(ids: Column, offset: int, denominator: Column) -> Column:
    """Entries ``(i, v)`` for the distinct positive ids, ascending: share of each in the denominator.

    The ids are sorted and cut into runs, so the work grows with the list and not with its square.
    """

    def runs(ids: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(0), F.size(ids) - 1),
            lambda i: (i == 0) | (F.get(ids, i) != F.get(ids, i - 1)),
        )

        def entry(starts: Column) -> Column:
            def one(start: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1), F.size(ids))
                return F.struct(
                    (F.get(ids, start) + offset).cast("int").alias("i"),
                    ((end - start) / denominator).alias("v"),
                )

            return F.transform(starts, one)

        none = F.array().cast(_PARTS)
        return F.when(F.size(ids) > 0, _let(starts, entry)).otherwise(none)

    return _let(F.sort_array(F.filter(ids, lambda x: x > 0)), runs)


def single_id(id_: Column, offset: int) -> Column:
    """``counted_ids`` of a list of one: the entry of a positive id, with value 1."""
    entry = F.struct((id_ + offset).cast("int").alias("i"), F.lit(1.0).alias("v"))
    return F.when(id_ > 0, F.array(entry).cast(_PARTS)).otherwise(F.array().cast(_PARTS))


def _dense_entries(values: Column, offset: int, width: int) -> Column:
    """Entries of a dense vector of ``width`` values; zeros are left out."""
    if width <= UNROLLED:
        none = F.struct(F.lit(-1).alias("i"), F.lit(0.0).alias("v"))
        xs = [F.get(values, F.lit(k)).cast("double") for k in range(width)]
        each = [F.when(x != 0, F.struct(F.lit(offset + k).alias("i"), x.alias("v"))).otherwise(none) for k, x in enumerate(xs)]
        return F.array_remove(F.array(*each), none).cast(_PARTS)
    places = F.sequence(F.lit(offset), F.lit(offset + width - 1))
    entries = F.arrays_zip(places, F.slice(values, 1, width))  # their fields go by number, as they have no names
    return F.filter(entries, lambda e: e["1"] != 0).cast(_PARTS)


def design_entries(layout: FeatureLayout, blocks: Sequence[Block], hash_buckets: int) -> Column:
    """Entries ``(i, v)`` of a design row, by rising index, from the columns of ``build_examples``.

    A single id counts 1. Ids of a list share 1 among those that are not 0, as mean pooling of their
    vectors would; ids of a sequence share it among all events before its length.
    """
    parts = []
    domains = {d.name: d for d in layout.domains}
    by_fid = {(f.group, f.fid): f for f in layout.features}
    for block in blocks:
        if block.route == "dense":
            parts.append(_dense_entries(F.col(f"{block.group}_feats"), block.offset, block.width))
            continue
        if block.route == "word2vec":
            parts.append(_dense_entries(F.col(block.pooled), block.offset, block.width))
            continue
        if block.group in domains:
            domain = domains[block.group]
            length = F.col(f"{domain.name}_len")
            ids = F.slice(F.col(f"{domain.name}.{domain.column(block.fid)}"), F.lit(1), length)
            denominator = F.greatest(length, F.lit(1))
        else:
            f = by_fid[block.group, block.fid]
            if f.length == 1:
                id_ = F.get(f"{block.group}_feats", F.lit(f.offset))
                parts.append(single_id(hash_bucket(id_, hash_buckets) if block.route == "hash" else id_, block.offset))
                continue
            ids = F.slice(F.col(f"{block.group}_feats"), f.offset + 1, f.length)
            denominator = F.greatest(F.size(F.filter(ids, lambda x: x > 0)), F.lit(1))
        if block.route == "hash":
            ids = F.transform(ids, lambda x: hash_bucket(x, hash_buckets))
        parts.append(counted_ids(ids, block.offset, denominator))
    return F.concat(*parts) if parts else F.array().cast(_PARTS)


def _sparse(width: int) -> Column:
    """The struct behind a sparse ML vector, of the column ``_entries``."""
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"),
        F.lit(width).alias("size"),
        F.col("_entries.i").alias("indices"),
        F.col("_entries.v").alias("values"),
    )


def entries_to_vector(entries: Column, width: int) -> Column:
    """An ML vector of entries ``(i, v)``.

    Vectors have a struct behind them, but no cast leads from one to the other; reading the struct as
    JSON does, without leaving the JVM. Doubles are written so that they read back the same.
    """
    return F.from_json(F.to_json(F.struct(_sparse(width).alias("v"))), _VECTOR)["v"]


def design_vectors(
    df: DataFrame, layout: FeatureLayout, blocks: Sequence[Block], hash_buckets: int, keep: Sequence[str], name: str = "features"
) -> DataFrame:
    """``keep`` and the sparse design vector of every example."""
    entries = df.select(*keep, design_entries(layout, blocks, hash_buckets).alias("_entries"))
    return entries.select(*keep, entries_to_vector(F.col("_entries"), design_width(blocks)).alias(name))


def stored_design(
    df: DataFrame, layout: FeatureLayout, blocks: Sequence[Block], hash_buckets: int, keep: Sequence[str], name: str = "features"
) -> DataFrame:
    """``design_vectors`` written once as compressed columns: for fits and metrics, which read them several times.

    The struct behind the vectors is what is written, so they are read back without a way through text.
    """
    entries = df.select(*keep, design_entries(layout, blocks, hash_buckets).alias("_entries"))
    rows = entries.select(*keep, _sparse(design_width(blocks)).alias(name))
    return packed(rows, T.StructType([*rows.schema.fields[:-1], T.StructField(name, VectorUDT())]))


def pooled_blocks(blocks: Sequence[Block]) -> Mapping[str, Block]:
    """The ``word2vec`` blocks by the name under which their vectors are kept."""
    return {f"{b.group}_{b.fid}": b for b in blocks if b.route == "word2vec"}
