"""Model-ready examples: one projection over the impressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.fixed_values import DEFAULT_TZ_HOURS, HOLIDAYS
from tidemark.functions.ids import derive_label
from tidemark.functions.timefeat import (
    calendar_ids,
    calendar_ids_seq,
    day_type_seq,
    recency_bucket_seq,
)
from tidemark.operators.assemble import (
    append_calendar_dense,
    append_calendar_ids,
    assemble_vector,
    build_sequence,
    build_sequence_length,
    dense_vector_with_presence,
    sequence_times,
)
from tidemark.operators.item_history import attach_item_history, history_vector
from tidemark.schema import FeatureLayout, SequenceDomain


def sequence_features(
    domain: SequenceDomain,
    now: Column,
    tz_hours: float = DEFAULT_TZ_HOURS,
    holidays: Sequence[str] = HOLIDAYS,
) -> list[Column]:
    """Ids, length, recency, calendar and day-type ids of one domain."""
    times, d, n = sequence_times(domain), domain.name, domain.max_len
    return [
        build_sequence(domain).alias(d),
        build_sequence_length(domain).alias(f"{d}_len"),
        recency_bucket_seq(now, times, n).alias(f"{d}_time_bucket"),
        calendar_ids_seq(times, tz_hours, n).alias(f"{d}_time_feats"),
        day_type_seq(times, tz_hours, holidays, n).alias(f"{d}_day_type_feats"),
    ]


def _kept_entries(df: DataFrame, layout: FeatureLayout) -> list[Column]:
    """The raw columns of the layout, lists cut to the entries that are used."""
    limits = {f.column: f.length for f in layout.features}
    for d in layout.domains:
        limits.update({d.column(fid): d.max_len for fid, _ in d.fields})
        if d.ts_column:
            limits[d.ts_column] = d.max_len
    is_list = {f.name: isinstance(f.dataType, T.ArrayType) for f in df.schema.fields}
    return [
        F.slice(c, 1, n).alias(c) if is_list[c] else F.col(c) for c, n in limits.items()
    ]


def build_examples(
    df: DataFrame,
    layout: FeatureLayout,
    history: DataFrame | None = None,
    training: bool = True,
    calendar: bool = True,
    keep: Sequence[str] = ("user_id", "item_id", "timestamp"),
    tz_hours: float = DEFAULT_TZ_HOURS,
    holidays: Sequence[str] = HOLIDAYS,
    presence: bool = False,
) -> DataFrame:
    """Label, flat vectors and sequences of every impression.

    ``presence`` adds the 0/1 mask of observed user values as ``user_dense_presence``.


    Lists are cut to their kept length before the item lookup, which may shuffle the
    rows, and padded and unfolded into features only after it.
    """
    label_type = ["label_type"] if training else []
    needed = dict.fromkeys([*keep, "item_id", "timestamp", *label_type])
    rows = df.select(*needed, *_kept_entries(df, layout))
    groups = ("user_int", "item_int", "user_dense", "item_dense")
    vectors = {g: assemble_vector(layout, g) for g in groups}
    if history is not None:
        rows = attach_item_history(rows, history)
        vectors["item_dense"] = F.concat(vectors["item_dense"], history_vector())
    ts = F.col("timestamp")
    now = calendar_ids(ts, tz_hours)
    if calendar:
        for g in ("user_int", "item_int"):
            vectors[g] = append_calendar_ids(vectors[g], now)
        vectors["user_dense"] = append_calendar_dense(vectors["user_dense"], now)
    masks = []
    if presence:
        masks.append(dense_vector_with_presence(layout, "user_dense")[1].alias("user_dense_presence"))
    label = derive_label(F.col("label_type") if training else F.lit(None), training)
    return rows.select(
        *keep,
        label.alias("label"),
        *[vectors[g].alias(f"{g}_feats") for g in groups],
        *masks,
        now.alias("time_feats"),
        *[c for d in layout.domains for c in sequence_features(d, ts, tz_hours, holidays)],
    )
