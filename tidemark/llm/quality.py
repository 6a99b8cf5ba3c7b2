"""Quality rules whose limits follow the corpus: quantile sketches per language and source."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Batches, WordHashes, as_binary, stored, table
from tidemark.llm.substring_dedup import window_hashes

#: Fixed values.
SYMBOLS, SPACES = b"#*$%&|<>", b" \t\n\v\f\r"
COUNTS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Limits:
    """How limits are drawn from a group's quantiles.

    The upper limit of a measure is its median plus `reach` times the distance of the upper quartile, or times
    the measure's `least` distance if that is more; the lower limit, used for word length, mirrors it. Groups of fewer
    than `group_rows` documents use the sketch of their language, then that of all. Buckets
    of a sketch grow by `accuracy`.
    """

    reach: float = 6.0
    least: tuple[tuple[str, float], ...] = (("word_length", 0.35), ("symbols", 0.05), ("dup_lines", 0.08), ("repeats", 0.03))
    group_rows: int = 200
    accuracy: float = 0.01


def repeated_words(x: np.ndarray, width: int = 5) -> int:
    """Words inside windows of `width` words that occur twice or more in the text."""
    h = window_hashes(x, width)
    if len(h) < 2:
        return 0
    _, inverse, counts = np.unique(h, return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    if not hit.any():
        return 0
    edge = np.zeros(len(x) + 1, np.int64)
    edge[: len(hit)] += hit
    edge[width : width + len(hit)] -= hit
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def line_counts(text: bytes) -> tuple[int, int]:
    """Lines that hold a word, and how many of those equal an earlier one."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines), len(lines) - len(set(lines))


def _counted(batches: Batches) -> Batches:
    hashes = WordHashes()
    continuation = slice(0x80, 0xC0)
    for batch in batches:
        out: list[tuple[int, ...]] = []
        for text in as_binary(batch.column("text")):
            words = text.split()
            of = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
            spaces = sum(int(of[b]) for b in SPACES)
            chars = len(text) - int(of[continuation].sum()) - spaces
            out.append((len(words), chars, sum(int(of[b]) for b in SYMBOLS), *line_counts(text), repeated_words(hashes.of(words))))
        names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
        columns = np.array(out, np.int64).reshape(len(out), 6).T
        yield table(
            {c: batch.column(c) for c in ("doc_id", "lang", "source")}
            | {c: pa.array(v) for c, v in zip(names, columns, strict=True)}
        )


def quality_counts(documents: DataFrame) -> DataFrame:
    """Per row its id, language, source and the counts that the rules rest on; a null text has none."""
    return documents.select("doc_id", "text", F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(
        _counted, COUNTS
    )


def _measures() -> dict[str, Column]:
    words, lines = F.greatest("n_words", F.lit(1)), F.greatest("n_lines", F.lit(1))
    return {
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / words,
        "dup_lines": F.col("n_dup_lines") / lines,
        "repeats": F.col("n_repeat_words") / words,
    }


def _bucket(x: Column, accuracy: float) -> Column:
    """Number of the bucket of a value; values from 1e-4 on fall into buckets that grow by `accuracy`."""
    return F.when(x < 1e-4, -1).otherwise(F.floor(F.log(F.greatest(x, F.lit(1e-4)) * 1e4) / float(np.log1p(accuracy)))).cast("int")


def sketches(counts: DataFrame, limits: Limits) -> DataFrame:
    """(lang, source, measure, bucket, rows): a histogram with growing buckets for every group.

    Sketches merge by adding rows of equal buckets, so tasks make partial ones and the result does
    not depend on their order. A measure has a few hundred buckets at most.
    """
    values = F.array(*(F.struct(F.lit(k).alias("measure"), v.alias("x")) for k, v in _measures().items()))
    each = counts.select("lang", "source", F.explode(values).alias("m"))
    return each.groupBy("lang", "source", "m.measure", _bucket(F.col("m.x"), limits.accuracy).alias("bucket")).agg(
        F.count("*").alias("rows")
    )


def _fences(sketch: DataFrame, by: list[str], limits: Limits) -> DataFrame:
    """Per group of `by` (merged sketches): its rows, and a lower and an upper limit for every measure."""
    merged = sketch.groupBy(*by, "measure", "bucket").agg(F.sum("rows").alias("rows"))
    group = Window.partitionBy(*by, "measure")
    placed = merged.withColumn("upto", F.sum("rows").over(group.orderBy("bucket"))).withColumn("all", F.sum("rows").over(group))
    value = F.when(F.col("bucket") < 0, 0.0).otherwise(1e-4 * F.pow(F.lit(1 + limits.accuracy), F.col("bucket") + 0.5))
    at = {q: F.min(F.when(F.col("upto") >= F.col("all") * q, value)) for q in (0.25, 0.5, 0.75)}
    found = placed.groupBy(*by, "measure").agg(
        F.max("all").alias("rows"), *(v.alias(f"q{int(100 * q)}") for q, v in at.items())
    )
    least = F.create_map(*(F.lit(x) for pair in limits.least for x in pair))[F.col("measure")]
    found = found.withColumn("high", F.col("q50") + limits.reach * F.greatest(F.col("q75") - F.col("q50"), least)).withColumn(
        "low", F.col("q50") - limits.reach * F.greatest(F.col("q50") - F.col("q25"), least)
    )
    names = [k for k, _ in limits.least]
    of = lambda c, k: F.max(F.when(F.col("measure") == k, F.col(c))).alias(f"{c}_{k}")
    return found.groupBy(*by).agg(F.max("rows").alias("rows"), *(of("high", k) for k in names), of("low", "word_length"))


def thresholds(counts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(lang, source, limits): those of the group, of its language, or of all, by how many rows each has."""
    sketch = stored(sketches(counts, limits))
    names = [*(f"high_{k}" for k, _ in limits.least), "low_word_length"]
    pack = lambda level, df: df.select(
        *[c for c in ("lang", "source") if c in df.columns], F.struct("rows", *names).alias(level)
    )
    own = pack("own", _fences(sketch, ["lang", "source"], limits))
    lang = pack("by_lang", _fences(sketch, ["lang"], limits)).withColumnRenamed("lang", "l")
    every = pack("by_all", _fences(sketch.withColumn("one", F.lit(1)), ["one"], limits))
    # One row, so every executor may hold it.
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("l")), "left").withColumn("one", F.lit(1)).join(
        F.broadcast(every.withColumn("one", F.lit(1))), "one", "left"
    )
    pick = F.when(F.col("own.rows") >= limits.group_rows, F.col("own")).when(
        F.col("by_lang.rows") >= limits.group_rows, F.col("by_lang")
    ).otherwise(F.col("by_all"))
    return both.select("lang", "source", pick.alias("limits"))


def judge_quality(documents: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per row: its counts, whether the base rule fails it (`base_failed`) and whether it is `kept`.

    The base rule fails texts of fewer than 10 words, or with more than a fifth of their words in
    repeated windows. The others are kept if word length, symbols, repeated lines and repeated words, each
    in proportion, are within the limits of their language and source, which are drawn from all texts
    that pass the base rule. Null languages and sources are groups of their own; a null or empty
    text fails; repeated rows are judged each; extra columns are ignored.
    """
    counts = stored(quality_counts(documents))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    passed = counts.where(~failed)
    found = thresholds(passed, limits).select(F.col("lang").alias("l"), F.col("source").alias("s"), "limits")
    joined = counts.join(found, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    inside = F.lit(True)
    for name, value in _measures().items():
        inside = inside & (value <= F.col(f"limits.high_{name}"))
    inside = inside & (_measures()["word_length"] >= F.col("limits.low_word_length"))
    kept = F.when(failed, False).otherwise(F.coalesce(inside, F.lit(True)))
    return joined.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), kept.alias("kept"),
    )
