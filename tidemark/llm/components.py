"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of `edges` (a, b); a component is its smallest node.

    Alternating stars: every node hands its larger neighbours to its smallest one, then
    every node hands its smaller neighbours and itself to the smallest. Each round is written
    to the shared folder. The rounds end when the edges stay as they are; then each edge
    joins a node with the root of its component. Nulls and loops are left out.
    """
    edges = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
        .distinct()
    )
    state = _digest(edges)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        edges = stored(_small_star(_large_star(edges)))
        before, state = state, _digest(edges)
        if before == state:
            break
    else:
        raise RuntimeError("the components did not settle")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct()
    )


def _digest(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(
        F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))
    ).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is joined with the smallest of the node and its neighbours."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(
        edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    )
    root = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    above = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"))
    return above.join(root, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are joined with the smallest of those."""
    root = edges.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = edges.join(root, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(root.withColumnRenamed("m", "lo")).distinct()
