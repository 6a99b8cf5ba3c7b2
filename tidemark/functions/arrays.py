"""Padding, truncation, masks and slices of array columns.

Everything here is a per-row expression, so no row has to move.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.ids import clean_id


#: Positions that are written out one by one, so that Spark compiles them; longer lists take a function
#: over their elements, which Spark interprets.
UNROLLED = 128


def _head(values: Column, n: int, element: str) -> Column:
    """First ``n`` elements; a null list is an empty one."""
    return F.slice(F.coalesce(values, F.array().cast(f"array<{element}>")), 1, n)


def list_length(values: Column, n: int) -> Column:
    """Raw entries kept after truncation to ``n``, counting entries later zeroed."""
    return F.least(F.greatest(F.coalesce(F.size(values), F.lit(0)), F.lit(0)), F.lit(n))


def fill_to(values: Column, n: int, filler: Column, length: Column) -> Column:
    """``values``, known to hold ``length`` entries, followed by ``filler`` up to ``n``.

    The length comes from the raw list, so that ``values`` is evaluated once.
    """
    return F.concat(values, F.array_repeat(filler, F.lit(n) - length))


def pad_int_list(values: Column, n: int) -> Column:
    """First ``n`` ids, nulls and non-positive ids as 0, padded with 0 on the right."""
    zero = F.lit(0).cast("long")
    head = F.transform(
        _head(values, n, "bigint"), lambda x: F.greatest(F.coalesce(x, zero), zero)
    )
    return fill_to(head, n, zero, list_length(values, n))


def pad_id_list(values: Column, n: int, vocab: int) -> Column:
    """``pad_int_list`` followed by ``clean_id`` in one pass over the elements."""
    zero = F.lit(0).cast("long")
    if vocab <= 0:
        return F.array_repeat(zero, n)
    head = F.transform(_head(values, n, "bigint"), lambda x: clean_id(x, vocab))
    return fill_to(head, n, zero, list_length(values, n))


def pad_time_list(values: Column, n: int) -> Column:
    """First ``n`` timestamps, null as 0, padded with 0; negative ones are kept."""
    zero = F.lit(0).cast("long")
    return fill_to(time_list(values, n), n, zero, list_length(values, n))


def time_list(values: Column, n: int) -> Column:
    """First ``n`` timestamps, null as 0, without padding."""
    zero = F.lit(0).cast("long")
    return F.transform(_head(values, n, "bigint"), lambda t: F.coalesce(t, zero))


def pad_float_list(values: Column, n: int) -> Column:
    """First ``n`` values, padded with 0.0 on the right."""
    return fill_to(_head(values, n, "double"), n, F.lit(0.0), list_length(values, n))


def _finite(x: Column) -> Column:
    """True for a finite number, false or null for all else: only finite numbers are 0 less themselves."""
    return x - x == F.lit(0.0)


def pad_float_list_with_presence(values: Column, n: int) -> tuple[Column, Column]:
    """Padded values and a 0/1 mask; null, NaN and infinite entries count as absent."""
    zero, one = F.lit(0.0), F.lit(1.0)
    if n <= UNROLLED:
        xs = [F.get(values, F.lit(i)).cast("double") for i in range(n)]
        known = [_finite(x) for x in xs]
        cleaned = F.array(*[F.when(k, x).otherwise(zero) for k, x in zip(known, xs)])
        return cleaned, F.array(*[F.when(k, one).otherwise(zero) for k in known])
    head, length = _head(values, n, "double"), list_length(values, n)
    cleaned = F.transform(head, lambda x: F.when(_finite(x), x).otherwise(zero))
    present = F.transform(head, lambda x: F.when(_finite(x), one).otherwise(zero))
    return fill_to(cleaned, n, zero, length), fill_to(present, n, zero, length)


def segment_presence(presence: Column) -> Column:
    """One flag for a whole block: set when any position of it is present."""
    return F.array_max(presence)


def append_presence(values: Column, presence: Column) -> Column:
    """Values followed by their mask."""
    return F.concat(values, presence)


def append_segment_presence(values: Column, presence: Column) -> Column:
    """Values followed by the single flag of the block."""
    return F.concat(values, F.array(segment_presence(presence)))


def take_range(vector: Column, start: int, end: int) -> Column:
    """Positions ``start .. end-1``, padded with 0.0 when the vector is shorter."""
    return pad_float_list(F.slice(vector, start + 1, end - start), end - start)


def padding_mask(length: Column, n: int) -> Column:
    """True at the positions past ``length``."""
    kept = F.least(length, F.lit(n))
    return fill_to(F.array_repeat(F.lit(False), kept), n, F.lit(True), kept)


def most_recent_k(values: Column, length: Column, k: int) -> Column:
    """The ``k`` newest entries of a newest-first sequence, zeros past its length."""
    kept = F.least(length, F.lit(k))
    return fill_to(F.slice(values, F.lit(1), kept), k, F.lit(0).cast("long"), kept)


def most_recent_k_mask(length: Column, k: int) -> Column:
    """Padding mask of ``most_recent_k``."""
    return padding_mask(F.least(length, F.lit(k)), k)


def sequence_length(columns: Sequence[Column], n: int) -> Column:
    """Longest side-information list of a domain, after truncation to ``n``."""
    lengths = [list_length(c, n) for c in columns]
    return F.greatest(*lengths) if len(lengths) > 1 else lengths[0]


def valid_tokens(values: Column, max_len: int | None = None) -> Column:
    """Positive ids only, then the first ``max_len`` if one is given: the sentence of a row."""
    tokens = F.filter(values, lambda x: x > 0)
    return tokens if max_len is None else F.slice(tokens, 1, max_len)
