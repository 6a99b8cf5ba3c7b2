"""From raw columns to flat vectors and padded sequences, driven by the layout.

All results are Columns, meant for one ``select``: the rows never move.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.fixed_values import OTHER_BRANCH
from tidemark.functions.arrays import (
    pad_float_list,
    pad_float_list_with_presence,
    pad_id_list,
    pad_int_list,
    pad_time_list,
    sequence_length,
    time_list,
)
from tidemark.functions.ids import clean_id
from tidemark.functions.maths import TRANSFORMS, transform_array
from tidemark.functions.timefeat import cyclical_time
from tidemark.schema import FeatureLayout, SequenceDomain


def _concat(parts: Sequence[Column], element: str) -> Column:
    return F.concat(*parts) if parts else F.array().cast(f"array<{element}>")


def int_vector(layout: FeatureLayout, group: str) -> Column:
    """Cleaned ids of a group in layout order."""
    parts = []
    for f in layout.group(group):
        c = F.col(f.column)
        parts.append(
            F.array(clean_id(c, f.vocab))
            if f.length == 1
            else pad_id_list(c, f.length, f.vocab)
        )
    return _concat(parts, "bigint")


def dense_vector(layout: FeatureLayout, group: str) -> Column:
    """Padded values of a group in layout order, as they are stored."""
    return _concat(
        [pad_float_list(F.col(f.column), f.length) for f in layout.group(group)], "double"
    )


def dense_vector_with_presence(layout: FeatureLayout, group: str) -> tuple[Column, Column]:
    """Padded values of a group and the 0/1 mask of observed positions."""
    pairs = [
        pad_float_list_with_presence(F.col(f.column), f.length) for f in layout.group(group)
    ]
    return (
        _concat([v for v, _ in pairs], "double"),
        _concat([p for _, p in pairs], "double"),
    )


def assemble_vector(layout: FeatureLayout, group: str) -> Column:
    """Flat vector of any group; absent and non-finite dense values are 0."""
    if group.endswith("_int"):
        return int_vector(layout, group)
    return dense_vector_with_presence(layout, group)[0]


def plan_branches(
    layout: FeatureLayout, group: str, branches: Sequence[tuple[str, Sequence[int], str]]
) -> list[tuple[str, list[int], str]]:
    """Branches with the fids that exist; uncovered fids go to a raw rest branch."""
    present = [f.fid for f in layout.group(group)]
    for _, _, transform in branches:
        if transform not in TRANSFORMS:
            raise ValueError(f"unknown value transform: {transform}")
    plan = [
        (name, [fid for fid in fids if fid in present], transform)
        for name, fids, transform in branches
    ]
    plan = [b for b in plan if b[1]]
    covered = {fid for _, fids, _ in plan for fid in fids}
    rest = [fid for fid in present if fid not in covered]
    if rest:
        plan.append((OTHER_BRANCH, rest, "raw"))
    if not plan:
        raise ValueError(f"no active branch for {group}")
    return plan


def branch_vectors(
    vector: Column,
    layout: FeatureLayout,
    group: str,
    branches: Sequence[tuple[str, Sequence[int], str]],
    transform: bool = False,
) -> Column:
    """Struct with one array per branch, cut out of the flat vector.

    With ``transform`` the value transform of each branch is applied as well.
    """
    by_fid = {f.fid: f for f in layout.group(group)}
    fields = []
    for name, fids, how in plan_branches(layout, group, branches):
        part = _concat(
            [F.slice(vector, by_fid[f].offset + 1, by_fid[f].length) for f in fids], "double"
        )
        fields.append((transform_array(part, how) if transform else part).alias(name))
    return F.struct(*fields)


def apply_branch_transform(
    vector: Column,
    layout: FeatureLayout,
    group: str,
    branches: Sequence[tuple[str, Sequence[int], str]],
) -> Column:
    """Branch vectors after raw, log1p_nonneg or signed_log1p."""
    return branch_vectors(vector, layout, group, branches, transform=True)


def plan_groups(
    layout: FeatureLayout, group: str, named: Mapping[str, Sequence[int]] | None
) -> dict[str, list[int]]:
    """Feature positions per group; without a group file every feature stands alone.

    Calendar ids added by ``with_calendar`` join the last group.
    """
    features = layout.group(group)
    position = {f.fid: i for i, f in enumerate(features) if not f.is_calendar}
    calendar = [i for i, f in enumerate(features) if f.is_calendar]
    if named is None:
        plan = {str(fid): [i] for fid, i in position.items()}
    else:
        unknown = [fid for fids in named.values() for fid in fids if fid not in position]
        if unknown:
            raise ValueError(f"group file names unknown {group} fids: {unknown}")
        plan = {name: [position[fid] for fid in fids] for name, fids in named.items()}
    if calendar:
        plan.setdefault("calendar" if not plan else list(plan)[-1], []).extend(calendar)
    return plan


def group_ids(
    vector: Column,
    layout: FeatureLayout,
    group: str,
    named: Mapping[str, Sequence[int]] | None = None,
) -> Column:
    """Struct with the ids of each group, cut out of the flat vector."""
    features = layout.group(group)
    return F.struct(
        *[
            _concat(
                [F.slice(vector, features[i].offset + 1, features[i].length) for i in members],
                "bigint",
            ).alias(name)
            for name, members in plan_groups(layout, group, named).items()
        ]
    )


def build_sequence(domain: SequenceDomain) -> Column:
    """Side-information lists of a domain, truncated, cleaned and padded, as a struct."""
    return F.struct(
        *[
            pad_id_list(F.col(domain.column(fid)), domain.max_len, vocab).alias(
                domain.column(fid)
            )
            for fid, vocab in domain.fields
        ]
    )


def sequence_times(domain: SequenceDomain) -> Column:
    """Timestamps of a domain, truncated, not padded; negative ones are kept."""
    if domain.ts_column is None:
        return F.array().cast("array<bigint>")
    return time_list(F.col(domain.ts_column), domain.max_len)


def build_sequence_times(domain: SequenceDomain) -> Column:
    """Timestamps of a domain, truncated and padded with 0."""
    if domain.ts_column is None:
        return F.array_repeat(F.lit(0).cast("long"), domain.max_len)
    return pad_time_list(F.col(domain.ts_column), domain.max_len)


def build_sequence_length(domain: SequenceDomain) -> Column:
    return sequence_length(
        [F.col(domain.column(fid)) for fid, _ in domain.fields], domain.max_len
    )


def raw_sequence(domain: SequenceDomain, fid: int) -> Column:
    """One side-information list padded without a vocabulary check."""
    return pad_int_list(F.col(domain.column(fid)), domain.max_len)


def append_calendar_ids(int_vector_: Column, calendar: Column) -> Column:
    """Hour, weekday and period ids behind an int vector (see ``with_calendar``)."""
    ids = [calendar.getField(n).cast("long") for n in ("hour", "weekday", "period")]
    return F.concat(int_vector_, F.array(*ids))


def append_calendar_dense(dense_vector_: Column, calendar: Column) -> Column:
    """Cyclical hour and weekday behind a dense vector."""
    return F.concat(
        dense_vector_, cyclical_time(calendar.getField("hour"), calendar.getField("weekday"))
    )
