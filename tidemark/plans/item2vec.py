"""Item2vec: ids that occur near each other get like vectors.

The vectors are factors of the shifted positive pointwise mutual information of window
pairs, which is what skip-gram with negative sampling approximates. Pairs are counted by
Spark and factorised by its ALS, which weighs a pair by its information and takes all
others as absent, so nothing passes through the driver or one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.recommendation import ALS
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.storage import packed, stored
from tidemark.operators.vocab import dense_ids, limit_sentences, sentences, top_k_vocab


def window_pairs(rows: DataFrame, window: int) -> DataFrame:
    """``feature``, ``a``, ``b``, ``n``: how often b stands within ``window`` tokens of a.

    Every pair counts in both directions. A token meets at most ``window`` later ones, so
    the rows grow with the tokens; counts are combined map-side. A list is set beside itself at every
    distance, so pairs carry no list, and they are turned round only once they are counted.
    """

    def beside(distance: int) -> Column:
        n = F.greatest(F.size("tokens") - distance, F.lit(0))
        return F.arrays_zip(F.slice("tokens", F.lit(1), n), F.slice("tokens", F.lit(distance + 1), n))

    near = rows.select("feature", F.explode(F.concat(*map(beside, range(1, window + 1)))).alias("p"))
    each = near.groupBy("feature", F.col("p.0").alias("a"), F.col("p.1").alias("b")).agg(F.count("*").alias("n"))
    both = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    turned = each.select("feature", "n", F.explode(both).alias("p")).select("feature", "p.a", "p.b", "n")
    return turned.groupBy("feature", "a", "b").agg(F.sum("n").alias("n"))


def shifted_pmi(pairs: DataFrame, shift: float = 1.0) -> DataFrame:
    """``feature``, ``a``, ``b``, ``n``, ``pmi``: log of n * all / (n_a * n_b), less log ``shift``, 0 at least."""
    of_a = pairs.groupBy("feature", "a").agg(F.sum("n").alias("n_a"))
    of_b = of_a.select("feature", F.col("a").alias("b"), F.col("n_a").alias("n_b"))
    total = of_a.groupBy("feature").agg(F.sum("n_a").alias("n_all"))
    all_ = pairs.join(of_a, ["feature", "a"]).join(of_b, ["feature", "b"]).join(total, "feature")
    ratio = F.col("n") * F.col("n_all") / (F.col("n_a").cast("double") * F.col("n_b"))
    pmi = F.greatest(F.ln(ratio) - F.lit(math.log(shift)), F.lit(0.0))
    return all_.select("feature", "a", "b", "n", pmi.alias("pmi"))


def fit_item2vec_many(
    df: DataFrame,
    specs: Sequence[tuple[str, int, str]],
    dim: int = 64,
    window: int = 5,
    min_count: int = 5,
    max_len: int | None = None,
    iterations: int = 5,
    shift: float = 1.0,
    penalty: float = 0.01,
    weight: float = 10.0,
    top_k: int | None = None,
    max_sentences: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """``feature`` (name_fid), ``raw_id``, ``compact_id``, ``vector`` for every ``(name, fid, column)``.

    Row 0 of each feature is all zeros, and so are ids without a neighbour. All rows and all ids that occur
    ``min_count`` times are used unless ``top_k`` or ``max_sentences`` ask for fewer; the
    latter needs ``src_file`` and ``src_row``. All features are counted and factorised in one pass.
    """
    spark = df.sparkSession
    parts = []
    for name, fid, column in specs:
        rows = sentences(df, column, max_len)
        if max_sentences is not None:
            rows = limit_sentences(rows, max_sentences)
        parts.append(rows.select(F.lit(f"{name}_{fid}").alias("feature"), "tokens"))
    rows = packed(reduce(DataFrame.unionByName, parts))
    counts = rows.select("feature", F.explode("tokens").alias("token")).groupBy("feature", "token")
    counts = stored(counts.agg(F.count("*").alias("cnt")).where(F.col("cnt") >= min_count))

    vocabs = []
    for feature in dict.fromkeys(f"{name}_{fid}" for name, fid, _ in specs):
        own = counts.where(F.col("feature") == feature).select("token", "cnt")
        own = dense_ids(own.select(F.col("token").alias("raw_id"))) if top_k is None else top_k_vocab(own, top_k)
        vocabs.append(own.select(F.lit(feature).alias("feature"), "raw_id", "compact_id"))
    vocab = reduce(DataFrame.unionByName, vocabs)
    # Every (feature, id) is a row and a column of one matrix; its number is dense over all features.
    keyed = vocab.withColumn("key", F.struct("feature", "compact_id"))
    vocab = stored(dense_ids(keyed, "key", "number").drop("key"))

    near = stored(shifted_pmi(stored(window_pairs(rows, window)), shift).where("pmi > 0").drop("n"))
    side = vocab.select("feature", "raw_id", F.col("number").cast("int").alias("number"))
    a, b = (side.select("feature", F.col("raw_id").alias(c), F.col("number").alias(f"row_{c}")) for c in "ab")
    matrix = stored(near.join(a, ["feature", "a"]).join(b, ["feature", "b"]).select("row_a", "row_b", "pmi"))
    empty = F.array_repeat(F.lit(0.0).cast("float"), dim)
    if matrix.isEmpty():
        found = vocab.select("feature", "raw_id", "compact_id", empty.alias("vector"))
    else:
        als = ALS(
            rank=dim, maxIter=iterations, regParam=penalty, alpha=weight, implicitPrefs=True,
            userCol="row_a", itemCol="row_b", ratingCol="pmi", seed=seed,
        )
        factors = als.fit(matrix.repartition("row_a").sortWithinPartitions("row_a", "row_b")).userFactors
        joined = vocab.join(factors, F.col("number") == F.col("id"), "left")
        found = joined.select("feature", "raw_id", "compact_id", F.coalesce("features", empty).alias("vector"))
    names = spark.createDataFrame([(f"{name}_{fid}",) for name, fid, _ in specs], "feature string").distinct()
    zero = F.lit(0).cast("long")
    return names.select("feature", zero.alias("raw_id"), zero.alias("compact_id"), empty.alias("vector")).unionByName(found)


def fit_item2vec(df: DataFrame, column: str, **options) -> DataFrame:
    """``raw_id``, ``compact_id`` and ``vector`` of one column; see ``fit_item2vec_many``."""
    return fit_item2vec_many(df, [(column, 0, column)], **options).drop("feature")
