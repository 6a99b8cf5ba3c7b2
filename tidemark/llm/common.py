"""What the operators of this package share: words, hashes, stored tables, row identity."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Bytes of an Arrow batch with texts. Spark's own limit of 10,000 rows makes batches of 35 MB and more, which a task
#: holds on both sides of the pipe, and twice while a buffer grows; that memory is outside the heap and stays.
BATCH_BYTES = 4 << 20
#: Distinct words a task keeps hashed before it starts anew; bounds a Python worker's memory.
CACHE_WORDS = 100_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below `spark.checkpoint.dir`, or below the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stored"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """`df` written as a table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def in_short_batches(df: DataFrame) -> DataFrame:
    """`df`, whose session from now on sends texts to Python `BATCH_BYTES` at a time, where it has no limit of its own."""
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(limit, None) is None:
        conf.set(limit, str(BATCH_BYTES))
    return df


#: Ids that may be sent to every executor, some 20 MB; more of them are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def sent_if_few(ids: DataFrame) -> DataFrame:
    """`ids` (one id column, stored), marked for broadcast if counting shows that they are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def sampled(df: DataFrame, order: Column, most: int) -> DataFrame:
    """At most `most` rows of `df`: those whose 64-bit hash `order` lies in the lowest slices that fit.

    The range of the hash is cut into 4096 slices, and the lowest one again while it alone is too
    much; only counts of slices come to the driver. Rows of one hash stay or go together.
    """
    low = F.lit(True)
    for bits in (52, 40, 28, 16, 4):
        part = F.shiftrightunsigned(order, bits)
        counts = dict(map(tuple, df.where(low).groupBy(part.alias("__slice")).count().collect()))
        total, cut = 0, None
        for at in sorted(counts):
            total += counts[at]
            if total > most:
                cut = at
                break
        if cut is None:
            return df.where(low)
        if cut > min(counts):
            return df.where(low & (part < cut))
        low = low & (part == cut)
    return df.where(F.lit(False))


def slot(key: Column, modulus: int) -> Column:
    """crc32 of an id written as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def as_binary(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text, b"" for a null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


class WordHashes(dict):
    """64-bit hashes of words, computed once per distinct word."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), U64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (finaliser with two multiplications)."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def lists(flat: np.ndarray, sizes: list[int], kind: pa.DataType) -> pa.ListArray:
    """Consecutive runs of `flat`, of the given sizes, as a list column."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def table(columns: dict[str, object]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(columns)


Batches = Iterator[pa.RecordBatch]
