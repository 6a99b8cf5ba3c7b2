"""Mixing sources by temperature: an exponent on their token shares, realised by permuted blocks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a block's place in a permutation, and of the buckets in which places are summed first.
PLACE_BITS, BUCKET_BITS = 52, 12
#: Blocks that even a small source is cut into.
MIN_BLOCKS = 64


@dataclass(frozen=True)
class Mixture:
    """What a mix aims at.

    Weights are shares ** exponent, normalised. The exponent is the largest in [0, 1] whose
    weights have an entropy of `entropy` times the maximum, unless a source would then be read
    more than `max_repeats` times; in that case it is the smallest one that keeps to the limit.
    `budget_tokens` is the size of the mix; by default the smallest at which every source is read once at least.
    """

    entropy: float = 0.95
    max_repeats: float = 3.0
    budget_tokens: int | None = None
    block_tokens: int = 1 << 16
    max_sources: int = 10_000
    seed: int = 17


def tempered(tokens: np.ndarray, exponent: float) -> np.ndarray:
    """Normalised weights of sources with these token counts (all above 0)."""
    logs = exponent * np.log(tokens)
    w = np.exp(logs - logs.max())
    return w / w.sum()


def budget_of(tokens: np.ndarray, weights: np.ndarray, goal: Mixture) -> float:
    return float(goal.budget_tokens) if goal.budget_tokens else float(np.max(tokens / weights))


def find_exponent(tokens: np.ndarray, goal: Mixture) -> float:
    """Bisects the exponent; both the entropy and the most repeats fall as it rises."""
    if len(tokens) < 2:
        return 1.0

    def spread(a: float) -> float:
        w = tempered(tokens, a)
        return float(-(w * np.log(np.maximum(w, 1e-300))).sum() / np.log(len(tokens)))

    def repeats(a: float) -> float:
        w = tempered(tokens, a)
        return float(np.max(budget_of(tokens, w, goal) * w / tokens))

    def border(too_low) -> float:
        """The a from which on `too_low` no longer holds; 0 or 1 where it never or always does."""
        if not too_low(0.0):
            return 0.0
        if too_low(1.0):
            return 1.0
        low, high = 0.0, 1.0
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if too_low(middle) else (low, middle)
        return high

    by_entropy = border(lambda a: spread(a) >= goal.entropy)
    return max(by_entropy, border(lambda a: repeats(a) > goal.max_repeats))


def n_tokens(text: Column) -> Column:
    """White-space separated words of a text; a null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _place(epoch: Column, source: Column, block: Column, seed: int) -> Column:
    """A block's place in the permutation of one pass over its source."""
    return F.pmod(F.xxhash64(F.lit(seed), epoch.cast("long"), source, block), F.lit(1 << PLACE_BITS))


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text"), blocks)


def plan_mixture(documents: DataFrame, goal: Mixture = Mixture()) -> DataFrame:
    """One row per source: source, tokens, share, weight, exponent, passes, blocks, full, cut.

    A source is read `full` times whole; in one more pass, the blocks up to place `cut` are
    taken, which are the first in that pass's permutation to reach the budget (the block that reaches
    it is taken whole). Sources without tokens have weight 0 and are read once. A null source is a
    source like others. The table has at most `max_sources` rows, else this raises.
    """
    spark = documents.sparkSession
    rows = documents.select("source", n_tokens(F.col("text")).alias("tokens"), "doc_id", "text")
    totals = rows.groupBy("source").agg(F.sum("tokens").alias("tokens")).limit(goal.max_sources + 1).collect()
    if len(totals) > goal.max_sources:
        raise ValueError(f"more than {goal.max_sources} sources")
    totals = sorted(totals, key=lambda r: (r["source"] is not None, str(r["source"])))
    filled = [r for r in totals if r["tokens"]]
    tokens = np.array([float(r["tokens"]) for r in filled])
    exponent = find_exponent(tokens, goal)
    weights = tempered(tokens, exponent) if len(tokens) else tokens
    budget = budget_of(tokens, weights, goal) if len(tokens) else 0.0
    plan = {r["source"]: (float(budget * w / r["tokens"]), float(w)) for r, w in zip(filled, weights, strict=True)}

    table = []
    for r in totals:
        passes, weight = plan.get(r["source"], (1.0, 0.0))
        full = int(np.floor(passes + 1e-9))
        blocks = max(MIN_BLOCKS, -(-int(r["tokens"]) // goal.block_tokens))
        missing = max(0.0, (passes - full) * r["tokens"]) if passes - full > 1e-9 else 0.0
        share = r["tokens"] / tokens.sum() if len(tokens) else 0.0
        table.append((r["source"], int(r["tokens"]), float(share), weight, float(exponent), passes, blocks, full, missing))
    kind = documents.schema["source"].dataType.simpleString()
    names = f"source {kind}, tokens long, share double, weight double, exponent double, passes double, blocks long, full long, missing double"
    sources = spark.createDataFrame(table, names)

    # At most max_sources rows, so every executor may hold them.
    same = rows.select(F.col("source").alias("__s"), "tokens", "doc_id", "text")
    partly = F.broadcast(sources.where("missing > 0"))
    blocks = (
        same.join(partly.drop("tokens"), F.col("__s").eqNullSafe(F.col("source")))
        .groupBy("source", "full", "missing", _block(F.col("blocks")).alias("block"))
        .agg(F.sum("tokens").alias("tokens"))
        .withColumn("place", _place(F.col("full"), F.col("source"), F.col("block"), goal.seed))
        .withColumn("bucket", F.shiftright("place", PLACE_BITS - BUCKET_BITS))
    )
    # At most 2 ** BUCKET_BITS rows a source, then at most the blocks of one bucket.
    by_bucket = blocks.groupBy("source", "missing", "bucket").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("source").orderBy("bucket"))
    crossed = (
        by_bucket.withColumn("upto", upto)
        .where("upto >= missing and upto - tokens < missing")
        .select(F.col("source").alias("__s"), F.col("bucket").alias("__b"), (F.col("upto") - F.col("tokens")).alias("before"))
    )
    inner = blocks.join(
        F.broadcast(crossed), F.col("source").eqNullSafe(F.col("__s")) & (F.col("bucket") == F.col("__b"))
    )
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy("source").orderBy("place", "block"))
    cuts = inner.withColumn("upto", upto).where("upto >= missing").groupBy("source").agg(F.min("place").alias("cut"))
    found = {r["source"]: r["cut"] for r in cuts.collect()}
    return spark.createDataFrame([(*r[:-1], found.get(r[0], -1)) for r in table], names.replace("missing double", "cut long"))


def _copies(documents: DataFrame, plan: DataFrame, goal: Mixture) -> DataFrame:
    """`documents` with `__block` and `__epoch`, a row for each time that a row is taken."""
    small = F.broadcast(plan.select(*(F.col(c).alias(f"__{c}") for c in plan.columns)))
    rows = documents.join(small, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__block", _block(F.col("__blocks")))
    last = _place(F.col("__full"), F.col("__source"), F.col("__block"), goal.seed) <= F.col("__cut")
    times = F.col("__full") + last.cast("long")
    rows = rows.withColumn("__times", times).where("__times > 0")
    return rows.withColumn("__epoch", F.explode(F.expr("sequence(0L, __times - 1L)")))


def mix_sources(documents: DataFrame, goal: Mixture = Mixture()) -> DataFrame:
    """The mix as rows (doc_id, source, n_tokens, epoch, block, place, weight, exponent).

    A document's row comes once for each time it is read. `place` lies in [0, 1): sorted by it, the
    blocks of all sources interleave in proportion to the weights, each pass over a source in an
    order of its own, and the documents of a block stay together. Repeated rows and null ids are read like any others;
    a null or empty text has no tokens. Extra columns are ignored.
    """
    rows = documents.select("doc_id", "text", "source")
    taken = _copies(rows, plan_mixture(rows, goal), goal)
    at = _place(F.col("__epoch"), F.col("__source"), F.col("__block"), goal.seed) / F.lit(float(1 << PLACE_BITS))
    return taken.select(
        "doc_id",
        "source",
        n_tokens(F.col("text")).alias("n_tokens"),
        F.col("__epoch").alias("epoch"),
        F.col("__block").alias("block"),
        ((F.col("__epoch") + at) / F.greatest(F.col("__passes"), F.col("__epoch") + 1.0)).alias("place"),
        F.col("__weight").alias("weight"),
        F.col("__exponent").alias("exponent"),
    )


def mixed_documents(documents: DataFrame, goal: Mixture = Mixture()) -> DataFrame:
    """`documents`, with the same columns, each row as often as the mix reads it."""
    return _copies(documents, plan_mixture(documents, goal), goal).select(*documents.columns)
