"""Scalar value transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def signed_log1p(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def log1p_nonneg(x: Column) -> Column:
    return F.log1p(F.greatest(x, F.lit(0.0)))


def safe_ratio(a: Column, b: Column) -> Column:
    """``a / b``, 0 when ``b`` is not positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def softplus(x: Column) -> Column:
    """``log(1 + exp(x))`` without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def bce_with_logit(logit: Column, label: Column) -> Column:
    """Binary cross entropy of one row, from the logit."""
    return F.greatest(logit, F.lit(0.0)) - logit * label + F.log1p(F.exp(-F.abs(logit)))


TRANSFORMS = {
    "raw": lambda x: x,
    "log1p_nonneg": log1p_nonneg,
    "signed_log1p": signed_log1p,
}


def transform_array(values: Column, name: str) -> Column:
    """One of the named value transforms on every element of an array."""
    if name not in TRANSFORMS:
        raise ValueError(f"unknown value transform: {name}")
    if name == "raw":
        return values
    return F.transform(values, TRANSFORMS[name])
