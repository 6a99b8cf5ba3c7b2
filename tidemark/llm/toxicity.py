"""Toxicity scores by a classifier that is told to ignore identity terms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import in_short_batches, sampled, slot

#: Groups of identity terms; the terms of a group are swapped for one another.
IDENTITY_TERMS = (
    ("women", "men", "woman", "man", "girls", "boys"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrant", "refugee", "citizen", "foreigner", "native"),
    ("deaf", "blind", "disabled", "autistic"),
    ("mujeres", "hombres", "musulmanes", "cristianos", "judíos"),
    ("femmes", "hommes", "musulmans", "chrétiens", "juifs"),
    ("frauen", "männer", "muslime", "christen", "juden"),
)
#: Characters cut from both ends of a word.
EDGES = "".join(map(chr, (*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)))) + "«»„“”‘’…¡¿"
PREFIXES = range(3, 8)
#: Words whose weights a task keeps, the only table of words it holds; some 8 MB.
SCORED_WORDS = 50_000


def word_features(word: str) -> list[str]:
    """The word itself, and each of its proper prefixes of three to seven characters."""
    return ["=" + word] + ["<" + word[:k] for k in PREFIXES if len(word) > k]


def distinct_words(text: str) -> set[str]:
    words = {token.strip(EDGES) for token in set(text.lower().split())}
    words.discard("")
    return words


@dataclass(frozen=True)
class ToxicityModel:
    """Weights of features; a text's logit is the bias plus the weights over its distinct words."""

    weights: dict[str, float]
    bias: float

    def score(self, text: Column) -> Column:
        """Probability of label 1; a null or empty text has the bias alone."""
        spark_weights, bias = self.weights, self.bias

        @F.pandas_udf(T.DoubleType())
        def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            known = _WordWeights(spark_weights)
            for texts in batches:
                logits = []
                for text in texts:
                    if len(known) > SCORED_WORDS:
                        known.clear()
                    logits.append(bias + sum(sorted(filter(None, map(known.__getitem__, distinct_words(text))))))
                yield pd.Series(1.0 / (1.0 + np.exp(-np.clip(np.array(logits, float), -500, 500))))

        return probability(F.coalesce(text, F.lit("")))


class _WordWeights(dict):
    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        found = self[word] = sum(self.weights.get(f, 0.0) for f in word_features(word))
        return found


def labelled_sample(documents: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(doc_id, text, toxic) of at most `max_rows` labelled ids, those with the smallest hashes.

    Only ids whose crc32 modulo 5 is not 0 are taken. Rows without a label or id are left out;
    an id labelled twice counts as toxic if one label says so. A document id that occurs
    more than once gives one row per text.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null")
        .where(slot(F.col("doc_id"), 5) != 0)
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    )
    chosen = sampled(known, F.xxhash64("__id"), max_rows)
    # Bounded by max_rows narrow rows, so every executor may hold them.
    return in_short_batches(documents).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic"
    ).dropDuplicates(["doc_id", "text"])


def fit_toxicity(
    documents: DataFrame,
    labels: DataFrame,
    *,
    max_rows: int = 20_000,
    max_features: int = 6_000,
    identity_terms: Sequence[Sequence[str]] = IDENTITY_TERMS,
    swap_penalty: float = 1.0,
    l1: float = 4e-4,
    rounds: int = 400,
) -> ToxicityModel:
    """Learns from a bounded sample of labelled rows.

    Features are ranked by a chi-squared statistic over the sample, in Spark; the best
    `max_features` and those of the identity terms reach the driver as sparse rows. The loss is
    logistic, with an l1 penalty and, for every identity term in a labelled text, a squared
    penalty on the change of the text's score when the term is swapped for another of its
    group or left out. Terms that no labelled text holds get one such penalty each.
    Without rows of both labels the score is the share of label 1 (0 without rows).
    """
    sample = labelled_sample(documents, labels, max_rows)
    totals = {int(r[0]): int(r[1]) for r in sample.groupBy("toxic").count().collect()}
    positive, negative = totals.get(1, 0), sum(v for k, v in totals.items() if k != 1)
    if not positive or not negative:
        share = positive / max(1, positive + negative)
        return ToxicityModel({}, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))

    terms = {f for group in identity_terms for t in group for f in word_features(t)}
    features = sample.mapInArrow(_feature_rows, "feature string, toxic int, uses int")
    n, p = float(positive + negative), float(positive)
    seen = features.groupBy("feature").agg(
        F.count("*").alias("df"), F.sum(F.expr("int(toxic = 1)")).alias("hits")
    ).where("df >= 3")
    expected = F.col("df") * (p / n)
    ranked = seen.withColumn("chi", (F.col("hits") - expected) ** 2 / (expected * (1 - p / n)))
    best = [r[0] for r in ranked.orderBy(F.desc("chi"), "feature").limit(max_features).select("feature").collect()]
    index = {f: k for k, f in enumerate(dict.fromkeys([*best, *sorted(terms)]))}

    rows = sample.mapInArrow(_indexed_rows(index), "toxic int, at array<int>, n array<int>").toArrow()
    at, n = (rows[c].combine_chunks() for c in ("at", "n"))
    x = _Sparse(at.value_lengths().to_numpy(), at.flatten().to_numpy(), n.flatten().to_numpy(), len(index))
    y = (rows["toxic"].to_numpy() == 1).astype(float)
    swaps = _swaps(x, index, identity_terms)
    weights, bias = _fit(x, y, swaps, swap_penalty, l1, rounds)
    return ToxicityModel({f: float(weights[k]) for f, k in index.items() if weights[k]}, bias)


def _feature_rows(batches):
    import pyarrow as pa

    for batch in batches:
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            found = sorted({f for w in distinct_words(text) for f in word_features(w)})
            yield pa.RecordBatch.from_pydict(
                {"feature": found, "toxic": pa.array([toxic] * len(found), pa.int32()), "uses": pa.array([1] * len(found), pa.int32())}
            ) if found else pa.RecordBatch.from_pydict(
                {"feature": pa.array([], pa.string()), "toxic": pa.array([], pa.int32()), "uses": pa.array([], pa.int32())}
            )


def _indexed_rows(index: dict[str, int]):
    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            at, counts = [], []
            for text in batch.column("text").to_pylist():
                found: dict[int, int] = {}
                for word in distinct_words(text):
                    for f in word_features(word):
                        if (k := index.get(f)) is not None:
                            found[k] = found.get(k, 0) + 1
                at.append(sorted(found))
                counts.append([found[k] for k in at[-1]])
            yield pa.RecordBatch.from_pydict(
                {"toxic": batch.column("toxic"), "at": pa.array(at, pa.list_(pa.int32())), "n": pa.array(counts, pa.list_(pa.int32()))}
            )

    return rows


class _Sparse:
    """Rows of (column, value) pairs, with the two products that the fit needs."""

    def __init__(self, sizes: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int):
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.col, self.val = columns.astype(np.int64), values.astype(float)
        self.shape = (len(sizes), width)

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.shape[0])

    def transposed_times(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * r[self.row], self.shape[1])


def _swaps(x: _Sparse, index: dict[str, int], groups) -> tuple[_Sparse, np.ndarray]:
    """Differences of feature rows when a term is swapped or left out, and how often each occurs."""
    uses = np.bincount(x.col, minlength=x.shape[1])
    sizes, at, values, weight = [], [], [], []

    def pair(old: str, new: str | None, times: float) -> None:
        change: dict[int, float] = {}
        for word, sign in ((old, -1.0), (new, 1.0)):
            for f in word_features(word) if word else ():
                change[index[f]] = change.get(index[f], 0.0) + sign
        change = {k: v for k, v in change.items() if v}
        sizes.append(len(change))
        at.extend(change)
        values.extend(change.values())
        weight.append(times)

    for group in groups:
        for old in group:
            times = max(1.0, float(uses[index["=" + old]]))
            pair(old, None, times)
            for new in group:
                if new != old:
                    pair(old, new, times / (len(group) - 1))
    return _Sparse(np.array(sizes), np.array(at), np.array(values), x.shape[1]), np.array(weight)


def _fit(x: _Sparse, y: np.ndarray, swaps, swap_penalty: float, l1: float, rounds: int) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient descent with a step found by halving."""
    d, times = swaps
    n = len(y)

    def smooth(w: np.ndarray, b: float):
        z = x.times(w) + b
        loss = np.mean(np.logaddexp(0, z) - y * z)
        r = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / n
        change = d.times(w)
        loss += swap_penalty * np.sum(times * change**2) / (2 * n)
        return loss, x.transposed_times(r) + d.transposed_times(swap_penalty * times * change / n), r.sum()

    w, b, step, t = np.zeros(x.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), 1.0, 1.0
    v, c = w.copy(), b
    for _ in range(rounds):
        loss, grad, grad_b = smooth(v, c)
        while True:
            moved = v - step * grad
            new, new_b = np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0), c - step * grad_b
            dw, db = new - v, new_b - c
            if smooth(new, new_b)[0] <= loss + grad @ dw + grad_b * db + (dw @ dw + db * db) / (2 * step) + 1e-12:
                break
            step /= 2
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_new * (new - w), new_b + (t - 1) / t_new * (new_b - b)
        moved_by = np.abs(new - w).max(initial=0)
        w, b, t, step = new, new_b, t_new, step * 1.2
        if moved_by < 1e-5:
            break
    return w, float(b)


def score_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; `held_out` rows were never learned from.

    Nulls and empty texts get the score of no words. Rows with the same text get the same score,
    and repeated rows stay. Other columns are ignored, whatever their names.
    """
    score = model.score(F.col("text"))
    return in_short_batches(documents).select("doc_id", "text").select(
        "doc_id", (slot(F.col("doc_id"), 5) == 0).alias("held_out"), score.alias("score")
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(documents: DataFrame, model: ToxicityModel, threshold: float = 0.5) -> DataFrame:
    """The rows of `documents`, with all their columns, whose score is below `threshold`."""
    return in_short_batches(documents).where(model.score(F.col("text")) < threshold)
