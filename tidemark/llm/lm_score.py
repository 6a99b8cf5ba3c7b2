"""Token log-probabilities from a log-bilinear model, learned by noise-contrastive estimation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import CACHE_WORDS, Batches, as_binary, slot, stored, table

#: Word classes by ending; a token's key holds its class in the lowest bits.
CLASSES = 256
#: Key of the end token: class 0, hash 0.
END = 0


@dataclass(frozen=True)
class LogBilinear:
    """Size of the model and of its training.

    The `words` most frequent words are symbols of their own, other words share the symbol of their
    class. A vector of `dim` numbers stands for every symbol as context, another as what
    follows. `noise` noise symbols are expected for every true one. Counts of the `known` most frequent
    tokens go to every task; those of all others are joined.
    """

    words: int = 1023
    dim: int = 32
    noise: float = 20.0
    steps: int = 200
    rate: float = 0.05
    known: int = 1 << 18
    seed: int = 5

    @property
    def symbols(self) -> int:
        return self.words + CLASSES + 1


class _Keys(dict):
    """Signed 64-bit keys of words: 56 bits of their hash, then the class of their ending."""

    def __missing__(self, word: bytes) -> int:
        key = (xxhash.xxh3_64_intdigest(word) & ~0xFF) | (xxhash.xxh3_64_intdigest(word[-3:]) & 0xFF)
        found = self[word] = key - (1 << 63)
        return found

    def of(self, text: bytes) -> np.ndarray:
        """The keys of a text's tokens: its words in lower case for A-Z, then the end."""
        if len(self) > CACHE_WORDS:
            self.clear()
        words = text.lower().split()
        keys = np.empty(len(words) + 1, np.int64)
        keys[:-1] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        keys[-1] = END
        return keys


def token_counts(documents: DataFrame) -> DataFrame:
    """(key, c): how often each token occurs in all texts; summed per batch before it moves."""

    def rows(batches: Batches) -> Batches:
        keys = _Keys()
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                texts = as_binary(batch.column("text").slice(low, 2000))
                found, n = np.unique(np.concatenate([keys.of(t) for t in texts]), return_counts=True)
                yield table({"key": pa.array(found), "c": pa.array(n.astype(np.int64))})

    each = documents.select("text").mapInArrow(rows, "key long, c long")
    return each.groupBy("key").agg(F.sum("c").alias("c"))


def _most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """At most `most` of the rows (key, c): those of the highest magnitudes of c that fit together.

    Magnitudes are 64 to a doubling, so a few thousand counts of rows tell where to cut.
    """
    magnitude = F.floor(F.log2("c") * 64)
    sizes = dict(map(tuple, counts.groupBy(magnitude.alias("m")).count().collect()))
    total, cut = 0, 0
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > most:
            cut = at + 1
            break
    return counts.where(magnitude >= cut)


class _Symbols:
    """The symbol of a key: its rank among the frequent words, or the place of its class; the end comes last."""

    def __init__(self, frequent: np.ndarray, words: int):
        order = np.argsort(frequent)
        self.sorted, self.rank, self.words = frequent[order], order, words

    def of(self, keys: np.ndarray) -> np.ndarray:
        out = self.words + (keys & 0xFF)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
            out = np.where(self.sorted[at] == keys, self.rank[at], out)
        out[keys == END] = self.words + CLASSES
        return out


def pair_counts(documents: DataFrame, frequent: np.ndarray, how: LogBilinear) -> DataFrame:
    """(pair, c): how often a symbol follows a context symbol, over all texts; the start is the last context.

    A pair is context * symbols + symbol, so there are at most symbols * (symbols + 1) rows.
    """
    k = how.symbols

    def rows(batches: Batches) -> Batches:
        keys, symbols = _Keys(), _Symbols(frequent, how.words)
        for batch in batches:
            for low in range(0, batch.num_rows, 2000):
                codes = []
                for text in as_binary(batch.column("text").slice(low, 2000)):
                    s = symbols.of(keys.of(text))
                    codes.append(np.concatenate(([k], s[:-1])) * k + s)
                found, n = np.unique(np.concatenate(codes), return_counts=True)
                yield table({"pair": pa.array(found.astype(np.int64)), "c": pa.array(n.astype(np.int64))})

    return documents.select("text").mapInArrow(rows, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))


def fit_log_bilinear(pairs: np.ndarray, counts: np.ndarray, how: LogBilinear) -> np.ndarray:
    """log10 P(symbol | context) as a matrix with a row for each context.

    The score of a symbol is the product of its vector with its context's, plus a bias. Noise-contrastive
    estimation tells true pairs from noise drawn from the symbols' frequencies; since pair counts
    are complete, its expectation over the noise is taken in full, by matrix products. Then the scores of each
    context are normalised.
    """
    k = how.symbols
    seen = np.zeros((k + 1) * k, np.float32)
    seen[pairs] = counts
    seen = seen.reshape(k + 1, k)
    total = float(seen.sum(dtype=np.float64))
    if not total:
        return np.full((k + 1, k), -np.log10(k), np.float32)
    seen /= total
    of_context = seen.sum(axis=1, dtype=np.float64).astype(np.float32)
    noise = seen.sum(axis=0, dtype=np.float64) + 0.5 / total
    noise = (noise / noise.sum()).astype(np.float32)
    rng = np.random.default_rng(how.seed)
    p = [
        (rng.standard_normal((k + 1, how.dim)) * 0.1).astype(np.float32),
        (rng.standard_normal((k, how.dim)) * 0.1).astype(np.float32),
        np.log(noise),
    ]
    shift = np.log(how.noise * noise)
    expected = how.noise * of_context[:, None] * noise[None, :]
    m, v = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p]
    for step in range(1, how.steps + 1):
        true = 1 / (1 + np.exp(-np.clip(p[0] @ p[1].T + (p[2] - shift), -30, 30)))
        g = seen * (1 - true) - expected * true
        rate = how.rate * (1 - step / (how.steps + 1))
        for at, grad in enumerate((g @ p[1], g.T @ p[0], g.sum(axis=0))):
            m[at] = 0.9 * m[at] + 0.1 * grad
            v[at] = 0.99 * v[at] + 0.01 * grad * grad
            p[at] = p[at] + rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(v[at] / (1 - 0.99**step)) + 1e-9)
    scores = (p[0] @ p[1].T + p[2]).astype(np.float64)
    top = scores.max(axis=1, keepdims=True)
    scores -= top + np.log(np.exp(scores - top).sum(axis=1, keepdims=True))
    return (scores / np.log(10)).astype(np.float32)


SCORED = "rid long, key long, n int, doc struct<doc_id: long, n_tokens: long, known: long, base: double, score: double>"


def score_texts(documents: DataFrame, training: Column | None = None, how: LogBilinear = LogBilinear()) -> DataFrame:
    """Base and model log10 probabilities of every text, learned from the rows where `training` holds.

    By default those are the ids whose crc32 modulo 5 is not 1. P(token) is P(symbol | symbol before),
    times, for words that share a symbol, their smoothed share of it; the shares of the known words
    and of one unknown word sum to 1. All counts cover all training texts.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, one row per row
    of `documents`; repeated rows are scored each. A null or empty text is its end token. Without training texts all
    words are unknown. Extra columns are ignored.
    """
    if training is None:
        training = slot(F.col("doc_id"), 5) != 1
    spark = documents.sparkSession
    texts = documents.select("doc_id", "text")
    train = texts.where(training)

    counts = stored(token_counts(train))
    top = _most_frequent(counts, how.known).select("key", "c").toArrow()
    top_keys, top_c = top["key"].to_numpy(), top["c"].to_numpy()
    rank = np.lexsort([top_keys, -top_c])
    top_keys, top_c = top_keys[rank], top_c[rank]
    frequent = top_keys[top_keys != END][: how.words]
    row = counts.agg(F.sum("c"), F.count("*")).first()
    n_all, n_kinds = int(row[0] or 0), int(row[1])
    # At most CLASSES rows; words with a symbol of their own are taken out again.
    by_class = counts.where(F.col("key") != END).groupBy(F.col("key").bitwiseAND(0xFF).alias("k")).agg(
        F.sum("c").alias("c"), F.count("*").alias("v")
    )
    shared = np.zeros((2, CLASSES))
    for r in by_class.collect():
        shared[:, r["k"]] = r["c"], r["v"]
    c_of = dict(zip(top_keys.tolist(), top_c.tolist(), strict=True))
    for key in frequent.tolist():
        shared[:, key & 0xFF] -= c_of[key], 1
    share_log = np.log10(shared[0] + 0.5 * (shared[1] + 1))
    base_log = float(np.log10(n_all + 0.5 * (n_kinds + 1)))

    pairs = pair_counts(train, frequent, how).toArrow()
    follows = fit_log_bilinear(pairs["pair"].to_numpy(), pairs["c"].to_numpy(), how)

    order = np.argsort(top_keys)
    shipped = spark.sparkContext.broadcast((top_keys[order], np.log10(top_c[order] + 0.5), frequent, share_log, follows))

    def rows(batches: Batches) -> Batches:
        known_keys, known_log, frequent, share_log, follows = shipped.value
        keys_of, symbols, k = _Keys(), _Symbols(frequent, how.words), how.symbols
        half = np.log10(0.5)
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                part = batch.slice(low, 1000)
                flat, flat_n, sizes, docs = [], [], [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), as_binary(part.column("text")), strict=True):
                    keys = keys_of.of(text)
                    s = symbols.of(keys)
                    score = float(follows[np.concatenate(([k], s[:-1])), s].sum(dtype=np.float64))
                    in_class = (s >= how.words) & (s < how.words + CLASSES)
                    if len(known_keys):
                        at = np.minimum(np.searchsorted(known_keys, keys), len(known_keys) - 1)
                        known = known_keys[at] == keys
                        logs = np.where(known, known_log[at], half)
                    else:
                        known, logs = np.zeros(len(keys), bool), np.full(len(keys), half)
                    base = float(logs.sum()) - len(keys) * base_log
                    score += float((logs - share_log[keys & 0xFF])[in_class].sum())
                    rest, n = np.unique(keys[~known], return_counts=True)
                    flat.append(rest)
                    flat_n.append(n)
                    sizes.append(len(rest))
                    docs.append((doc_id, len(keys), int(known.sum()), base, score))
                yield _mixed_rows(part.column("rid").to_numpy(zero_copy_only=False), flat, flat_n, sizes, docs)

    mixed = texts.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(rows, SCORED)
    joined = mixed.join(counts, "key", "left")
    gain = F.when(F.col("c").isNotNull() & (F.col("n") > 0), F.col("n") * (F.log10(F.col("c") + 0.5) - F.log10(F.lit(0.5))))
    per = joined.groupBy("rid").agg(
        F.sum(gain).alias("gain"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("more"),
        *(F.max(f"doc.{c}").alias(c) for c in ("doc_id", "n_tokens", "known", "base", "score")),
    )
    gain = F.coalesce("gain", F.lit(0.0))
    return per.select(
        "doc_id",
        (slot(F.col("doc_id"), 5) == 1).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("base") + gain).alias("base_score"),
        (F.col("score") + gain).alias("score"),
    )


def _mixed_rows(rids: np.ndarray, flat, flat_n, sizes, docs) -> pa.RecordBatch:
    """A row for every distinct token of a text whose count is to be joined, and one that carries the text's sums."""
    keys = np.concatenate([*flat, rids * 0x9E3779B97F4A7C1 | (1 << 62)])
    n = np.concatenate([*flat_n, np.zeros(len(rids))]).astype(np.int32)
    rid = np.concatenate([np.repeat(rids, sizes), rids])
    kind = pa.struct({"doc_id": pa.int64(), "n_tokens": pa.int64(), "known": pa.int64(), "base": pa.float64(), "score": pa.float64()})
    names = [f.name for f in kind]
    whole = pa.array([dict(zip(names, d, strict=True)) for d in docs], kind)
    empty = pa.nulls(len(keys) - len(rids), kind)
    return table({"rid": pa.array(rid), "key": pa.array(keys), "n": pa.array(n), "doc": pa.concat_arrays([empty, whole])})
