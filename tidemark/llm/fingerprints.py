"""Fingerprints of texts from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import U64, Batches, mixed, table

#: A Mersenne prime, so a remainder is a shift and an addition, and two bases below it.
PRIME, BASES = (1 << 31) - 1, (1_103_515_245, 742_938_285)
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME for x < 2^63."""
    x = (x & U64(PRIME)) + (x >> U64(31))
    x = (x & U64(PRIME)) + (x >> U64(31))
    return np.where(x >= U64(PRIME), x - U64(PRIME), x)


def _powers_of(k: int, n: int) -> np.ndarray:
    """The first n powers of base k, by doubling what is there."""
    p = _powers[k]
    while len(p) < n:
        step = U64(int(p[-1]) * BASES[k] % PRIME)
        p = np.concatenate([p, _reduced(p * step)])
    _powers[k] = p
    return p[:n]


class Prefixes:
    """Prefix hashes of a text's code points under two bases: any span's hash in constant time."""

    def __init__(self, text: str):
        #: Span hashes by width, made once per text.
        self.made: dict[int, np.ndarray] = {}
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(U64) + U64(1)
        self.n = len(points)
        self.sums = []
        for k in range(2):
            terms = _reduced(points * _powers_of(k, self.n))
            total = np.zeros(self.n + 1, U64)
            np.cumsum(terms, out=total[1:])
            self.sums.append(_reduced(total))

    def spans(self, starts: np.ndarray, width: int, top: int | None = None) -> np.ndarray:
        """62-bit hashes of the spans of `width` from `starts`, moved to the power `top` (the last start by default)."""
        top = self.n if top is None else top
        parts = []
        for k in range(2):
            total = self.sums[k]
            part = _reduced(total[starts + width] + U64(PRIME) - total[starts])
            parts.append(_reduced(part * _powers_of(k, top + 1)[top - starts]))
        return (parts[0] << U64(31)) | parts[1]

    def same(self, i: int, other: Prefixes, j: int, width: int) -> bool:
        """Whether the span of `width` from i here equals that from j in `other`."""
        top = max(self.n, other.n)
        return bool(self.spans(np.array([i]), width, top)[0] == other.spans(np.array([j]), width, top)[0])

    def common_extension(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest span from i here that equals one from j in `other`, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same(i, other, j, middle) else (low, middle - 1)
        return low

    def common_before(self, i: int, other: Prefixes, j: int) -> int:
        """Length of the longest span that ends before i here and equals one that ends before j in `other`."""
        low, high = 0, min(i, j)
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if self.same(i - middle, other, j - middle, middle) else (low, middle - 1)
        return low

    def aligned(self, starts: np.ndarray, width: int) -> np.ndarray:
        """Hashes of the spans of `width` from `starts`, moved back to power 0: equal spans of any texts agree."""
        parts = []
        for k in range(2):
            total = self.sums[k]
            part = _reduced(total[starts + width] + U64(PRIME) - total[starts])
            parts.append(_reduced(part * _inverse_powers(k, int(starts[-1]) + 1)[starts]))
        return (parts[0] << U64(31)) | parts[1]

    def windows(self, width: int) -> np.ndarray:
        """The scrambled hashes of all spans of `width`, from the first on; none in a shorter text."""
        if width not in self.made:
            found = np.zeros(0, U64)
            if 0 < width <= self.n:
                found = mixed(self.aligned(np.arange(self.n - width + 1), width) ^ U64(width << 56))
            self.made[width] = found
        return self.made[width]

    def head(self, length: int) -> list[int]:
        """Hashes of the first `length` code points under both bases."""
        return [int(self.sums[k][length]) for k in range(2)]


class Joined:
    """Hashes of a text's head followed by another's, composed of theirs: H(a + b) = H(a) + p^|a| H(b)."""

    def __init__(self, a: Prefixes, a_length: int, b: Prefixes, b_length: int, seam: str, seam_start: int):
        self.a, self.b, self.at, self.more = a, b, a_length, b_length
        self.n = a_length + b_length
        #: The code points around the seam, the only ones that are hashed anew.
        self.seam, self.seam_start = Prefixes(seam), seam_start

    def whole(self) -> int:
        parts = []
        for k in range(2):
            power = int(_powers_of(k, self.at + 1)[self.at])
            parts.append((self.a.head(self.at)[k] + power * self.b.head(self.more)[k]) % PRIME)
        return parts[0] << 31 | parts[1]

    def windows(self, width: int) -> np.ndarray:
        if not 0 < width <= self.n:
            return np.zeros(0, U64)
        first, last = (p.windows(width)[: max(0, length - width + 1)] for p, length in ((self.a, self.at), (self.b, self.more)))
        return np.concatenate([first, self.seam.windows(width), last])


@dataclass(frozen=True)
class Fingerprinting:
    """A fingerprint keeps the `size` smallest hashes of a text's spans of `span` code points."""

    span: int = 16
    size: int = 64
    #: Ids are cut into ranges of about so many rows, but not into more ranges than `max_ranges`.
    rows_per_range: int = 4096
    max_ranges: int = 2000


def _smallest(x: np.ndarray, size: int) -> np.ndarray:
    """The `size` smallest distinct values in order, without sorting all."""
    most = 2 * size
    while most < len(x):
        found = np.unique(np.partition(x, most)[:most])
        if len(found) >= size:
            return found[:size]
        most *= 8
    return np.unique(x)[:size]


def _print_of(hashed: Prefixes | Joined, whole: int, how: Fingerprinting) -> tuple[str, np.ndarray]:
    if not hashed.n:
        return "0::", np.zeros(0, U64)
    found = _smallest(hashed.windows(min(how.span, hashed.n)), how.size)
    return f"{hashed.n}:{whole:016x}:" + found.astype(">u8").tobytes().hex(), found


def fingerprint(text: str | Prefixes, how: Fingerprinting) -> tuple[str, np.ndarray]:
    """The fingerprint as text, and its span hashes.

    It names the number of code points, the hash of the whole text and the smallest span hashes. A text
    shorter than a span has itself as its one span; the empty text has none.
    """
    hashed = text if isinstance(text, Prefixes) else Prefixes(text)
    first, second = hashed.head(hashed.n)
    return _print_of(hashed, first << 31 | second, how)


def edited_fingerprint(text: str, own: Prefixes, following: str, other: Prefixes, how: Fingerprinting) -> tuple[str, np.ndarray]:
    """The fingerprint of `edited(text, following)`, from the hashes of both and of the spans across their seam."""
    half = own.n // 2
    kept, more = own.n - half, min(half, other.n)
    width = min(how.span, kept + more)
    start, end = max(0, kept - width + 1), min(more, width - 1)
    joined = Joined(own, kept, other, more, text[start:kept] + following[:end], start)
    return _print_of(joined, joined.whole(), how)


def shared_span(own: tuple[Prefixes, np.ndarray], other: tuple[Prefixes, np.ndarray], how: Fingerprinting) -> int:
    """Length of the longest span around an anchor in both: the place of the smallest span hash that both
    fingerprints keep, extended to both sides as far as the texts agree. 0 without such a hash."""
    (a, kept_a), (b, kept_b) = own, other
    if not len(kept_a) or not len(kept_b):
        return 0
    common = kept_a[np.isin(kept_a, kept_b)]
    width = min(how.span, a.n)
    if not len(common) or width != min(how.span, b.n):
        return 0
    i, j = (int(np.flatnonzero(p.windows(width) == common[0])[0]) for p in (a, b))
    return a.common_before(i, b, j) + a.common_extension(i, b, j)


_inverse = [np.ones(1, U64), np.ones(1, U64)]
_INVERSE_BASES = [pow(b, -1, PRIME) for b in BASES]


def _inverse_powers(k: int, n: int) -> np.ndarray:
    """The first n powers of the inverse of base k, by doubling what is there."""
    p = _inverse[k]
    while len(p) < n:
        step = U64(int(p[-1]) * _INVERSE_BASES[k] % PRIME)
        p = np.concatenate([p, _reduced(p * step)])
    _inverse[k] = p
    return p[:n]


def likeness(a: tuple[str, np.ndarray], b: tuple[str, np.ndarray], size: int) -> float:
    """1 for equal fingerprints; else the share, among the smallest hashes of both, of those in both."""
    if a[0] == b[0]:
        return 1.0
    union = np.union1d(a[1], b[1])[:size]
    if not len(union):
        return 0.0
    return float(np.count_nonzero(np.isin(union, a[1]) & np.isin(union, b[1])) / len(union))


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many code points of the next text, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _fingerprint_rows(how: Fingerprinting):
    """Rows come by range, then by falling id; a `guest` row closes its range and is the next of its last row."""

    def row(one: tuple, following: tuple) -> tuple:
        (doc_id, text, hashed, own), (_, text2, hashed2, own2) = one, following
        changed = edited(text, text2)
        print_ = edited_fingerprint(text, hashed, text2, hashed2, how)
        return (
            doc_id, len(text), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own[0], print_[0],
            likeness(own, print_, how.size), likeness(own, own2, how.size), shared_span((hashed, own[1]), (hashed2, own2[1]), how),
        )

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = None
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "guest"))
            for doc_id, text, range_, guest in zip(*columns, strict=True):
                hashed = Prefixes(text)
                this = (range_, (doc_id, text, hashed, fingerprint(hashed, how)))
                if held is not None and held[0] == range_:
                    yield row(held[1], this[1])
                held = None if guest else this

    def rows(batches: Batches) -> Batches:
        names = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "shared_next")
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())
        out: list[tuple] = []

        def flushed() -> pa.RecordBatch:
            columns = zip(*out, strict=True)
            return table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

        for found in paired(batches):
            out.append(found)
            if len(out) == 500:
                yield flushed()
                out.clear()
        if out:
            yield flushed()

    return rows


PRINTED = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
    " near_edited double, near_next double, shared_next long"
)


def fingerprint_documents(documents: DataFrame, how: Fingerprinting = Fingerprinting()) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and how like it is to that and to the next document.

    `shared_next` is the length of a span that it has in common with the next document, extended from
    a span hash in both fingerprints.

    Next is the next smaller id, and after the smallest the largest; a lone row is its own next.
    Ids are cut into ranges at their quantiles; every range gets, as a guest, the first row of the
    range that follows, so one shuffle brings each row next to its neighbour. Null ids are smallest;
    rows of one id stand in the order of their texts' hashes; a null text is empty. Extra columns are ignored.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("at", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))))
    docs = docs.withColumn("tie", F.xxhash64("text"))
    n = docs.count()
    ranges = min(how.max_ranges, max(1, math.ceil(n / how.rows_per_range)))
    steps = [k / ranges for k in range(1, ranges)]
    cuts = docs.select(F.percentile_approx("at", F.array(*map(F.lit, steps)), 10 * ranges)).first()[0] if steps else []
    cuts = sorted(set(cuts or []))
    # One bound per range: a small array in the plan, searched per row.
    place = _range_of(F.col("at"), cuts)
    docs = docs.withColumn("range", place)
    heads = docs.groupBy("range").agg(F.max(F.struct("at", "tie")).alias("h")).collect()
    heads = sorted(((r["range"], r["h"]["at"], r["h"]["tie"]) for r in heads), reverse=True)
    if not heads:
        return docs.select("doc_id", "text", "range", F.lit(False).alias("guest")).mapInArrow(_fingerprint_rows(how), PRINTED)
    before = {following[1:]: one[0] for one, following in zip(heads, [*heads[1:], heads[0]], strict=True)}
    known = F.create_map(
        *(x for (at, tie), r in before.items() for x in (F.concat_ws(":", F.lit(str(at)), F.lit(str(tie))), F.lit(r)))
    )
    to = F.try_element_at(known, F.concat_ws(":", F.col("at").cast("string"), F.col("tie").cast("string")))
    seats = F.when(to.isNull(), F.array(F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")))).otherwise(
        F.array(
            F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")),
            F.struct(to.alias("range"), F.lit(True).alias("guest")),
        )
    )
    seated = docs.select("doc_id", "text", "at", "tie", F.explode(seats).alias("seat")).select(
        "doc_id", "text", "at", "tie", "seat.range", "seat.guest"
    )
    dealt = seated.repartitionById(len(cuts) + 1, F.col("range").cast("int")).sortWithinPartitions("range", "guest", F.desc("at"), F.desc("tie"))
    return dealt.select("doc_id", "text", "range", "guest").mapInArrow(_fingerprint_rows(how), PRINTED)


def _range_of(at, cuts: list[int]):
    """How many of the sorted `cuts` lie at or below `at`, by halving."""
    if not cuts:
        return F.lit(0)

    def search(low: int, high: int):
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(at >= cuts[middle], search(middle + 1, high)).otherwise(search(low, middle))

    return search(0, len(cuts))
