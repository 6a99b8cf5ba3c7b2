"""Removal of passages that an earlier document holds, found by difference-cover anchors."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, Batches, WordHashes, as_binary, mixed, table

#: A perfect difference set, so every difference modulo 31 is one of two residues of the set.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_BASE = 0x9E3779B97F4A7C15


@dataclass(frozen=True)
class Passage:
    """A passage is `window` words; an anchor has `window - PERIOD + 1`, so any passage holds aligned ones."""

    window: int = 50

    @property
    def anchor(self) -> int:
        if self.window < PERIOD:
            raise ValueError(f"a window needs {PERIOD} words at least")
        return self.window - PERIOD + 1


def window_hashes(x: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of every run of `width` words: differences of prefix sums, moved to one power."""
    if len(x) < width:
        return x[:0]
    powers, back = _powers(len(x))
    prefix = np.zeros(len(x) + 1, U64)
    np.cumsum(mixed(x) * powers, out=prefix[1:])
    runs = prefix[width:] - prefix[:-width]
    return mixed(runs * back[: len(runs)] + U64(width))


_made: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    if n > len(_made.get("up", ())):
        size = max(4096, 1 << (n - 1).bit_length())
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(size, U64(base))
            p[0] = 1
            _made[name] = np.cumprod(p)
    return _made["up"][:n], _made["down"][:n]


def anchor_places(n_words: int, width: int) -> np.ndarray:
    """Starts of anchors in a text: the places whose residue is in the cover."""
    return np.flatnonzero(np.resize(_IN_COVER, max(0, n_words - width + 1)))


def _anchor_rows(how: Passage):
    def rows(batches: Batches) -> Batches:
        hashes = WordHashes()
        for batch in batches:
            found, sizes = [], []
            for text in as_binary(batch.column("text")):
                x = hashes.of(text.split())
                h = window_hashes(x, how.anchor)
                found.append(h[anchor_places(len(x), how.anchor)] if len(x) >= how.window else h[:0])
                sizes.append(len(found[-1]))
            at = np.repeat(np.arange(len(sizes)), sizes)
            places = np.concatenate([np.arange(k) for k in sizes]) if sizes else at
            yield table(
                {
                    "anchor": pa.array(np.concatenate(found).view(np.int64) if found else at),
                    "k": batch.column("k").take(pa.array(at)),
                    "nth": pa.array(places.astype(np.int32)),
                }
            )

    return rows


def _candidate_rows(how: Passage):
    """Windows of a text that hold an anchor some other text has, each sequence once."""

    def rows(batches: Batches) -> Batches:
        hashes = WordHashes()
        for batch in batches:
            found, sizes = [], []
            for text, alone in zip(as_binary(batch.column("text")), batch.column("alone").to_pylist(), strict=True):
                x = hashes.of(text.split())
                h = window_hashes(x, how.window)
                if len(h):
                    h = np.unique(h[_touched(len(x), how, np.array(alone or [], np.int64))])
                found.append(h)
                sizes.append(len(h))
            at = np.repeat(np.arange(len(sizes)), sizes)
            yield table(
                {
                    "hash": pa.array(np.concatenate(found).view(np.int64) if found else at),
                    "id": batch.column("id").take(pa.array(at)),
                }
            )

    return rows


def _touched(n_words: int, how: Passage, alone: np.ndarray) -> np.ndarray:
    """Whether the window at each place holds an anchor that is not one of the `alone` ones."""
    places = anchor_places(n_words, how.anchor)
    shared = np.ones(len(places), bool)
    shared[alone] = False
    before = np.zeros(n_words - how.anchor + 2, np.int64)
    before[places[shared] + 1] = 1
    before = np.cumsum(before)
    starts = np.arange(n_words - how.window + 1)
    return before[starts + PERIOD] > before[starts]


def _result_rows(how: Passage):
    def rows(batches: Batches) -> Batches:
        hashes = WordHashes()
        for batch in batches:
            n, removed, digests = [], [], []
            columns = (batch.column(c).to_pylist() for c in ("copy", "alone", "first"))
            for text, copy, alone, first in zip(as_binary(batch.column("text")), *columns, strict=True):
                words = text.split()
                gone = _gone(hashes.of(words), how, copy, alone, first)
                kept = words if not gone.any() else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digests.append(hashlib.sha256(b" ".join(kept)).hexdigest())
            yield table(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_words": pa.array(n, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()),
                    "kept_sha256": pa.array(digests),
                }
            )

    return rows


def _gone(x: np.ndarray, how: Passage, copy: bool, alone, first) -> np.ndarray:
    """Which words to remove: those of a touched window whose hash is not among the text's own first ones."""
    gone = np.zeros(len(x), bool)
    if len(x) < how.window:
        return gone
    if copy:
        return ~gone
    touched = _touched(len(x), how, np.array(alone or [], np.int64))
    if not touched.any():
        return gone
    h = window_hashes(x, how.window)
    hit = touched & ~np.isin(h, np.array(first or [], np.int64).view(U64))
    edge = np.zeros(len(x) + 1, np.int64)
    edge[: len(hit)] += hit
    edge[how.window :] -= hit
    return np.cumsum(edge)[:-1] > 0


def remove_repeated_passages(documents: DataFrame, how: Passage = Passage()) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per row of `documents`.

    A word goes if a window of `window` words that covers it starts, as the same sequence, in a
    document with a smaller id too. Windows are hashed only at cover positions, as anchors: two
    texts with a common window share an aligned anchor inside it. An anchor of one text alone goes
    back to that text, and windows without any other anchor are out. The windows left are hashed whole;
    the smallest id of each hash keeps it, and hears so; a window of which a document does not
    hear is removed from it. No list of the documents of a hash is ever made, so a passage in
    any number of documents costs one row per task. Exact copies count as one text, and all but the
    one with the smallest id lose every word, if they have a window.

    A null text has no words. Rows that repeat an id do not remove from each other; a null id
    counts as smaller than all others. Extra columns are ignored.
    """
    body = F.coalesce("text", F.lit(""))
    texts = documents.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("id"),
        body.alias("text"),
        F.xxhash64(body).alias("k"),
        F.md5(body.cast("binary")).alias("digest"),
    )
    anchors = texts.select("k", "text").mapInArrow(_anchor_rows(how), "anchor long, k long, nth int")
    single = (
        anchors.groupBy("anchor")
        .agg(F.min("k").alias("k"), F.max("k").alias("k2"), F.min("nth").alias("nth"), F.max("nth").alias("nth2"))
        .where("k = k2 and nth = nth2")
    )
    alone = single.groupBy("k").agg(F.collect_list("nth").alias("alone"))
    marked = texts.join(alone, "k", "left")
    windows = marked.mapInArrow(_candidate_rows(how), "hash long, id long")
    firsts = windows.groupBy("hash").agg(F.min("id").alias("head"))
    first = firsts.groupBy("head").agg(F.collect_list("hash").alias("first"))

    # One row per k, so that the texts, dealt by k already, are not dealt again.
    heads = texts.groupBy("k", "digest").agg(F.min("id").alias("head"))
    same = heads.join(first, "head", "left").groupBy("k").agg(F.collect_list(F.struct("digest", "head", "first")).alias("same"))
    rows = texts.join(same.join(alone, "k", "left"), "k", "left")
    rows = rows.withColumn("own", F.filter("same", lambda h: h["digest"] == F.col("digest"))[0]).select(
        "doc_id", "text", (F.col("id") > F.col("own.head")).alias("copy"), "alone", F.col("own.first").alias("first")
    )
    return rows.mapInArrow(_result_rows(how), "doc_id long, n_words long, n_removed long, kept_sha256 string")
