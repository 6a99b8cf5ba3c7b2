"""Packing documents into sequences: best fit under several capacities at once."""

from __future__ import annotations

import base64
import json
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm.common import Batches, in_short_batches, table

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


@dataclass(frozen=True)
class Capacity:
    """Limits of one sequence. `docs` counts pieces, `attention` sums the squares of their lengths.

    `rule` picks among the open sequences that have room in every dimension: "norm" the one with the smallest
    weighted norm of what would be left, "dot" the one with the largest weighted dot product of what is
    left and what the piece takes. By default the last two limits cannot bind before the first.
    """

    tokens: int = 1024
    docs: int = 1024
    attention: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 0.001, 0.001)
    rule: str = "norm"
    #: Pieces that one task packs together, about.
    group_rows: int = 8192


class TokenIds:
    """Ids of texts as little-endian 32-bit bytes, as the tokenizer file `path` gives them.

    `ranks` holds the same vocabulary as merge ranks for a library that applies them several times
    faster. Texts with an added token of the tokenizer (its end of text) go through the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str, end_id: int):
        self.path, self.end, self.whole = path, array("I", [end_id]).tobytes(), None
        with open(path, encoding="utf-8") as f:
            self.added = [t["content"] for t in json.load(f)["added_tokens"]]
        with open(ranks, "rb") as f:
            merged = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merged, special_tokens={})

    def of(self, text: str) -> bytes:
        if any(t in text for t in self.added):
            self.whole = self.whole or Tokenizer.from_file(self.path)
            ids = self.whole.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array("I", ids).tobytes() + self.end


def cut_lengths(total: int, limit: int) -> list[int]:
    """The pieces of a document of `total` tokens: at most `limit` each, only the first may be shorter."""
    first = total % limit
    return [first] * (first > 0) + [limit] * (total // limit)


def tokenized_pieces(documents: DataFrame, limit: int, tokenizer: str, ranks: str, end_id: int) -> DataFrame:
    """One row per piece of every document: doc_id, piece, start, length, ids_crc32.

    A null text is empty and has the end token alone. Ids are not kept, only their checksum.
    """

    def rows(batches: Batches) -> Batches:
        tokens = TokenIds(tokenizer, ranks, end_id)
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                out = []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids, start = tokens.of(text or ""), 0
                    for k, n in enumerate(cut_lengths(len(ids) // 4, limit)):
                        out.append((doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
                        start += n
                a, b, c, d, e = zip(*out, strict=True)
                yield table(
                    {"doc_id": pa.array(a, pa.int64()), "piece": pa.array(b, pa.int32()), "start": pa.array(c, pa.int64()),
                     "length": pa.array(d, pa.int64()), "ids_crc32": pa.array(e, pa.int64())}
                )

    return in_short_batches(documents).select("doc_id", "text").mapInArrow(rows, PIECES)


def best_fit(lengths: np.ndarray, limit: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """For pieces in decreasing order of length: the sequence and offset of each.

    Open sequences stand in stacks by the tokens they have left. For a piece, the newest
    sequence of every stack with enough tokens is weighed in all three dimensions at once.
    """
    full = np.array([limit.tokens, limit.docs, limit.attention], float)
    scale = np.array(limit.weights) / full**2
    stacks: list[list[int]] = [[] for _ in range(limit.tokens + 1)]
    top = np.full((limit.tokens + 1, 3), -1.0)  # what the newest sequence of each stack has left
    left: list[np.ndarray] = []
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        need = np.array([n, 1.0, float(n) * n])
        if n > limit.tokens or (need > full).any():
            raise ValueError("a piece exceeds an empty sequence")
        room = top[n:] - need
        fits = (room >= 0).all(axis=1)
        if fits.any():
            score = (room * room) @ scale if limit.rule == "norm" else -((top[n:] * need) @ scale)
            level = n + int(np.where(fits, score, np.inf).argmin())
            at = stacks[level].pop()
            top[level] = left[stacks[level][-1]] if stacks[level] else -1.0
            rest = left[at] - need
        else:
            at, rest = len(left), full - need
            left.append(rest)
        where[k], offset[k] = at, limit.tokens - rest[0] - n
        left[at] = rest
        if rest[0] > 0 and rest[1] > 0:
            level = int(rest[0])
            stacks[level].append(at)
            top[level] = rest
    return where, offset


def pack(pieces: DataFrame, groups: int, limit: Capacity) -> DataFrame:
    """Adds sequence_id and offset. Pieces are dealt at random into `groups`, each packed in one task."""

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True])
        where, offset = best_fit(rows["length"].to_numpy(), limit)
        rows = rows.assign(sequence_id=(int(key[0]) << 32) + where, offset=offset)
        return rows.drop(columns="__group").astype({"doc_id": "Int64"})

    dealt = pieces.withColumn("__group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("__group").applyInPandas(packed, PACKED)


def pack_documents(
    documents: DataFrame,
    limit: Capacity = Capacity(),
    *,
    tokenizer: str = public_tokenizers.path("byte_bpe_50k.json"),
    ranks: str = public_tokenizers.path("byte_bpe_50k.tiktoken"),
    end_id: int = 2,
) -> DataFrame:
    """Packs all documents into few sequences; one row per piece.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id and offset (gapless from 0 in a
    sequence). Only documents longer than a sequence are cut. Repeated rows are packed each; a
    null id stays null; a null or empty text is its end token; extra columns are ignored.
    """
    groups = max(1, -(-documents.count() // limit.group_rows))
    return pack(tokenized_pieces(documents, limit.tokens, tokenizer, ranks, end_id), groups, limit)
