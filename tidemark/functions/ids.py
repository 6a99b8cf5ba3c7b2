"""Cleaning and bucketing of categorical ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_id(value: Column, vocab: int) -> Column:
    """Ids in ``1 .. vocab-1`` pass; null, non-positive and out-of-range become 0.

    A feature without a vocabulary (``vocab <= 0``) is 0 throughout.
    """
    zero = F.lit(0).cast("long")
    if vocab <= 0:
        return zero
    return F.when((value > 0) & (value < vocab), value.cast("long")).otherwise(zero)


def hash_bucket(value: Column, buckets: int) -> Column:
    """Positive ids go to ``1 .. buckets``, everything else to the padding id 0."""
    return (
        F.when(value > 0, F.pmod(value, F.lit(buckets).cast("long")) + 1)
        .otherwise(F.lit(0).cast("long"))
    )


def derive_label(label_type: Column, training: bool = True) -> Column:
    """1 for a conversion (label type 2), else 0; all 0 when scoring."""
    if not training:
        return F.lit(0)
    return (F.coalesce(label_type, F.lit(0)) == 2).cast("int")
