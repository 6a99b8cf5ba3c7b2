"""Evaluation metrics and losses."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.maths import bce_with_logit, sigmoid
from tidemark.operators.filters import drop_nan_scores
from tidemark.operators.storage import stored


def auc(scored: DataFrame, score: str, label: str) -> DataFrame:
    """Exact ROC AUC, ties counted half; 0.0 when empty or of a single class.

    Equal scores are merged, and the distinct ones dealt out by ranges drawn from the data,
    so no task gets more than its share, whatever the scale or crowding of the scores. The negatives
    below a score are those below it in its partition plus the totals of the partitions before,
    of which there is one row each.
    """
    positive = F.col(label).cast("long")
    merged = scored.groupBy(F.col(score).alias("score")).agg(
        F.sum(positive).alias("pos"), F.sum(1 - positive).alias("neg")
    )
    dealt = stored(merged.repartitionByRange("score").withColumn("part", F.spark_partition_id()))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("part").agg(F.sum("neg").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")
    )
    lower = Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(lower), F.lit(0)) + F.col("start")
    placed = dealt.join(F.broadcast(starts), "part").select("pos", "neg", below.alias("below"))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    won = F.sum(F.col("pos").cast("double") * (F.col("below") + F.col("neg") * 0.5))
    return placed.agg(F.when(pairs > 0, won / pairs).otherwise(F.lit(0.0)).alias("auc"))


def logloss(scored: DataFrame, logit: str, label: str) -> DataFrame:
    """Mean binary cross entropy from logits; infinity when empty."""
    loss = bce_with_logit(F.col(logit), F.col(label).cast("double"))
    return scored.agg(F.coalesce(F.avg(loss), F.lit(float("inf"))).alias("logloss"))


def evaluate(scored: DataFrame, logit: str = "logit", label: str = "label") -> DataFrame:
    """AUC and log loss in one row; NaN predictions are left out."""
    rows = drop_nan_scores(scored, logit).select(
        F.col(logit).alias("logit"), F.col(label).alias("label")
    )
    probs = rows.select(sigmoid(F.col("logit")).alias("prob"), "label")
    loss = logloss(rows, "logit", "label").scalar()
    return auc(probs, "prob", "label").select("auc", loss.alias("logloss"))


def focal_term(logit: Column, label: Column, alpha: float, gamma: float) -> Column:
    p = sigmoid(logit)
    p_t = p * label + (F.lit(1.0) - p) * (F.lit(1.0) - label)
    alpha_t = F.lit(float(alpha)) * label + F.lit(1.0 - alpha) * (F.lit(1.0) - label)
    focus = F.pow(F.lit(1.0) - p_t, F.lit(float(gamma)))
    return alpha_t * focus * bce_with_logit(logit, label)


def focal_loss(
    scored: DataFrame,
    logit: str = "logit",
    label: str = "label",
    alpha: float = 0.1,
    gamma: float = 2.0,
    reduction: str = "mean",
) -> DataFrame:
    """Alpha-weighted focal loss: ``mean``, ``sum``, or ``none`` for one value per row."""
    loss = focal_term(F.col(logit), F.col(label).cast("double"), alpha, gamma)
    if reduction == "none":
        return scored.withColumn("focal_loss", loss)
    if reduction not in ("mean", "sum"):
        raise ValueError(f"unknown reduction: {reduction}")
    agg = F.avg if reduction == "mean" else F.sum
    return scored.agg(agg(loss).alias("focal_loss"))


def with_block(df: DataFrame, position: str, block_rows: int) -> DataFrame:
    """Add ``block``: runs of ``block_rows`` consecutive positions.

    Positions are unique, so a block never holds more rows than that; it is what a batch
    is to the losses below.
    """
    block = F.call_function("div", F.col(position).cast("long"), F.lit(block_rows).cast("long"))
    return df.withColumn("block", block)


def _check_block(rows: int, limit: int) -> None:
    if rows > limit:
        raise ValueError(f"block of {rows} rows, limit {limit}: positions are not unique")


def _strips(values: np.ndarray, rows: int = 256) -> list[np.ndarray]:
    return [values[k : k + rows] for k in range(0, len(values), rows)]


def _log_sum_others(unit: np.ndarray, rows: np.ndarray, temperature: float) -> np.ndarray:
    """Log of the summed exponentials of each row's similarities to all vectors but its own."""
    x = unit[rows] @ unit.T / temperature
    x[np.arange(len(rows)), rows] = -np.inf
    top = x.max(axis=1)
    return top + np.log(np.exp(x - top[:, None]).sum(axis=1))


def pairwise_auc_loss(
    scored: DataFrame,
    position: str,
    logit: str = "logit",
    label: str = "label",
    block_rows: int = 1024,
) -> DataFrame:
    """Mean softplus(negative - positive) over the pairs of each block.

    A block without both classes gives no row. The pairs exist only as strips of a matrix
    in the task that holds the block, never as rows.
    """

    def loss(pdf: pd.DataFrame) -> pd.DataFrame:
        _check_block(len(pdf), block_rows)
        positive = pdf["label"].to_numpy() > 0.5
        x = pdf["logit"].to_numpy(dtype=np.float64)
        pos, neg = x[positive], x[~positive]
        out = {"block": [], "pairs": [], "loss": []}
        if len(pos) and len(neg):
            out["block"].append(pdf["block"].iloc[0])
            out["pairs"].append(len(pos) * len(neg))
            parts = [np.logaddexp(0.0, neg[None, :] - p[:, None]).sum() for p in _strips(pos)]
            out["loss"].append(sum(parts) / (len(pos) * len(neg)))
        return pd.DataFrame(out)

    rows = with_block(
        scored.select(
            F.col(position).alias("position"),
            F.col(logit).cast("double").alias("logit"),
            F.col(label).cast("double").alias("label"),
        ),
        "position",
        block_rows,
    )
    return (
        rows.drop("position")
        .groupBy("block")
        .applyInPandas(loss, "block long, pairs long, loss double")
    )


def contrastive_loss(
    df: DataFrame,
    position: str,
    vector: str = "vector",
    label: str = "label",
    block_rows: int = 1024,
    temperature: float = 0.1,
    positives_only: bool = False,
    pos_label: int = 1,
) -> DataFrame:
    """Supervised contrastive loss per block, with its number of anchors.

    Anchors without a partner of their label are left out; a block without any anchor
    has loss 0. An anchor's loss is the log of the summed exponentials of its similarities to all others,
    less its mean similarity to its partners. That mean needs no pairs: it is the product with the sum
    of its label's vectors, less the product with itself. The exponentials are taken in
    strips of the block.
    """

    def loss(pdf: pd.DataFrame) -> pd.DataFrame:
        _check_block(len(pdf), block_rows)
        unit = np.stack(pdf["vector"].to_numpy()).astype(np.float64)
        unit = unit / np.maximum(np.sqrt((unit**2).sum(axis=1)), 1e-12)[:, None]
        names, label = np.unique(pdf["label"].to_numpy(), return_inverse=True)
        label_sum = np.zeros((len(names), unit.shape[1]))
        np.add.at(label_sum, label, unit)
        partners = np.bincount(label)[label] - 1
        counted = partners > 0
        if positives_only:
            counted &= names[label] == pos_label
        at = np.flatnonzero(counted)
        if not len(at):
            return pd.DataFrame({"block": [pdf["block"].iloc[0]], "anchors": [0], "loss": [0.0]})
        own = (unit[at] ** 2).sum(axis=1)
        towards = ((unit[at] * label_sum[label[at]]).sum(axis=1) - own) / partners[at] / temperature
        apart = np.concatenate([_log_sum_others(unit, rows, temperature) for rows in _strips(at)])
        return pd.DataFrame(
            {"block": [pdf["block"].iloc[0]], "anchors": [len(at)], "loss": [float(np.mean(apart - towards))]}
        )

    rows = with_block(
        df.select(
            F.col(position).alias("position"),
            F.col(vector).alias("vector"),
            F.col(label).cast("long").alias("label"),
        ),
        "position",
        block_rows,
    )
    return (
        rows.drop("position")
        .groupBy("block")
        .applyInPandas(loss, "block long, anchors long, loss double")
    )
