"""Declared schema: feature groups, layouts of flat vectors, sequence domains.

The schema is metadata of a few hundred rows. It is parsed and laid out by Spark so that
it can be joined and checked like any table; ``FeatureLayout`` is its driver-side form,
needed because column expressions are built from it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.fixed_values import (
    CALENDAR_DENSE_FIDS,
    CALENDAR_VOCABS,
    DEFAULT_HASH_BUCKETS,
    DEFAULT_HASH_THRESHOLD,
    DEFAULT_SEQUENCE_LENGTH,
    ID_VOCAB_THRESHOLD,
    ITEM_HISTORY_FIDS,
    UNSCALED_RANGES,
)

SCHEMA_TYPE = (
    "struct<user_int:array<array<bigint>>, item_int:array<array<bigint>>,"
    " user_dense:array<array<bigint>>, item_dense:array<array<bigint>>,"
    " seq:map<string,struct<prefix:string,ts_fid:bigint,features:array<array<bigint>>>>>"
)
GROUPS_TYPE = (
    "struct<user_ns_groups:map<string,array<bigint>>,"
    " item_ns_groups:map<string,array<bigint>>>"
)


@dataclass(frozen=True)
class Feature:
    group: str
    fid: int
    offset: int
    length: int
    vocab: int = 0

    @property
    def column(self) -> str:
        return f"{self.group}_feats_{self.fid}"

    @property
    def is_calendar(self) -> bool:
        """Calendar ids have no raw column; their fids are negative."""
        return self.fid < 0


@dataclass(frozen=True)
class SequenceDomain:
    name: str
    prefix: str
    ts_fid: int | None
    fields: tuple[tuple[int, int], ...]
    max_len: int = DEFAULT_SEQUENCE_LENGTH

    def column(self, fid: int) -> str:
        return f"{self.prefix}_{fid}"

    @property
    def ts_column(self) -> str | None:
        return None if self.ts_fid is None else self.column(self.ts_fid)


@dataclass(frozen=True)
class FeatureLayout:
    features: tuple[Feature, ...]
    domains: tuple[SequenceDomain, ...] = ()

    def group(self, name: str) -> tuple[Feature, ...]:
        return tuple(f for f in self.features if f.group == name)

    def total_dim(self, group: str) -> int:
        return sum(f.length for f in self.group(group))

    def domain(self, name: str) -> SequenceDomain:
        return next(d for d in self.domains if d.name == name)

    def with_features(
        self, group: str, entries: Iterable[tuple[int, int, int]]
    ) -> FeatureLayout:
        """Append ``(fid, length, vocab)`` entries at the end of a group."""
        offset, added = self.total_dim(group), []
        for fid, length, vocab in entries:
            added.append(Feature(group, fid, offset, length, vocab))
            offset += length
        return replace(self, features=self.features + tuple(added))

    def with_item_history(self) -> FeatureLayout:
        """Append the twelve item-history values to ``item_dense``."""
        return self.with_features("item_dense", [(f, 1, 0) for f in ITEM_HISTORY_FIDS])

    def with_calendar(self) -> FeatureLayout:
        """Append calendar ids to both int groups and cyclical values to ``user_dense``."""
        out = self
        for group in ("user_int", "item_int"):
            out = out.with_features(group, [(-1 - i, 1, v) for i, v in enumerate(CALENDAR_VOCABS)])
        return out.with_features("user_dense", [(f, 1, 0) for f in CALENDAR_DENSE_FIDS])


def parse_max_lens(text: str) -> dict[str, int]:
    """``"seq_a:256,seq_b:128"`` as a mapping."""
    pairs = (p.split(":") for p in text.split(",") if p.strip())
    return {name.strip(): int(n) for name, n in pairs}


def _int_map(values: Mapping, key_type: str) -> Column:
    entries = [F.lit(x) for pair in values.items() for x in pair]
    return F.create_map(*entries).cast(f"map<{key_type},bigint>")


def parse_features(
    texts: DataFrame,
    column: str = "value",
    dim_overrides: Mapping[int, int] | None = None,
) -> DataFrame:
    """One row per declared feature: group, slot, fid, vocab, length."""
    s = F.from_json(F.col(column), SCHEMA_TYPE)

    def group(name: str, is_int: bool) -> Column:
        declared = F.coalesce(s.getField(name), F.array().cast("array<array<bigint>>"))

        def entry(e: Column, i: Column) -> Column:
            length = e[2] if is_int else e[1]
            if name == "user_dense" and dim_overrides:
                length = F.coalesce(
                    F.element_at(_int_map(dim_overrides, "bigint"), e[0]), length
                )
            return F.struct(
                F.lit(name).alias("group"),
                i.cast("long").alias("slot"),
                e[0].alias("fid"),
                (e[1] if is_int else F.lit(0).cast("long")).alias("vocab"),
                length.alias("length"),
            )

        return F.transform(declared, entry)

    return texts.select(
        F.inline(
            F.concat(
                group("user_int", True),
                group("item_int", True),
                group("user_dense", False),
                group("item_dense", False),
            )
        )
    )


def parse_sequences(
    texts: DataFrame, column: str = "value", max_lens: Mapping[str, int] | None = None
) -> DataFrame:
    """One row per sequence column: domain, prefix, slot, fid, vocab, is_ts, max_len.

    Side information keeps its order with the timestamp left out; the timestamp column
    has slot -1.
    """
    s = F.from_json(F.col(column), SCHEMA_TYPE)
    domains = texts.select(F.explode(s.getField("seq")).alias("domain", "cfg"))
    side = F.filter(F.col("cfg.features"), lambda e: ~e[0].eqNullSafe(F.col("cfg.ts_fid")))
    rows = F.concat(
        F.transform(
            side,
            lambda e, i: F.struct(
                i.cast("long").alias("slot"),
                e[0].alias("fid"),
                e[1].alias("vocab"),
                F.lit(False).alias("is_ts"),
            ),
        ),
        F.when(
            F.col("cfg.ts_fid").isNotNull(),
            F.array(
                F.struct(
                    F.lit(-1).cast("long").alias("slot"),
                    F.col("cfg.ts_fid").alias("fid"),
                    F.lit(0).cast("long").alias("vocab"),
                    F.lit(True).alias("is_ts"),
                )
            ),
        ).otherwise(F.array()),
    )
    default = F.lit(DEFAULT_SEQUENCE_LENGTH).cast("long")
    limit = default
    if max_lens:
        limit = F.coalesce(F.element_at(_int_map(max_lens, "string"), F.col("domain")), default)
    return domains.select(
        "domain", F.col("cfg.prefix").alias("prefix"), limit.alias("max_len"), F.inline(rows)
    )


def feature_layout(features: DataFrame) -> DataFrame:
    """Add each feature's offset in the flat vector of its group.

    Input rows are ``(group, slot, fid, vocab, length)``; the window runs over the
    features of one group, which is metadata.
    """
    before = (
        Window.partitionBy("group").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    )
    return features.withColumn(
        "offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))
    )


def positions_to_features(positions: DataFrame) -> DataFrame:
    """Features from per-position rows ``(group, slot, fid, vocab)``: vocab is the maximum."""
    return positions.groupBy("group", "slot", "fid").agg(
        F.max("vocab").alias("vocab"), F.count("*").alias("length")
    )


def _to_layout(features: DataFrame, sequences: DataFrame) -> FeatureLayout:
    rows = feature_layout(features).orderBy("group", "slot").collect()
    fs = tuple(Feature(r["group"], r["fid"], r["offset"], r["length"], r["vocab"]) for r in rows)
    domains: dict[str, dict] = {}
    for r in sequences.orderBy("domain", "slot").collect():
        d = domains.setdefault(
            r["domain"],
            {"prefix": r["prefix"], "ts_fid": None, "fields": [], "max_len": r["max_len"]},
        )
        if r["is_ts"]:
            d["ts_fid"] = r["fid"]
        else:
            d["fields"].append((r["fid"], r["vocab"]))
    return FeatureLayout(
        fs,
        tuple(
            SequenceDomain(n, d["prefix"], d["ts_fid"], tuple(d["fields"]), d["max_len"])
            for n, d in domains.items()
        ),
    )


def layout_from_text(
    texts: DataFrame,
    dim_overrides: Mapping[int, int] | None = None,
    max_lens: Mapping[str, int] | None = None,
) -> FeatureLayout:
    """Layout of one schema document held in the ``value`` column of ``texts``."""
    return _to_layout(
        parse_features(texts, dim_overrides=dim_overrides),
        parse_sequences(texts, max_lens=max_lens),
    )


def load_feature_schema(
    spark: SparkSession,
    path: str,
    dim_overrides: Mapping[int, int] | None = None,
    max_lens: Mapping[str, int] | None = None,
) -> FeatureLayout:
    """Read ``schema.json`` from any file system Spark reaches."""
    return layout_from_text(spark.read.text(path, wholetext=True), dim_overrides, max_lens)


def load_groups(spark: SparkSession, path: str) -> dict[str, dict[str, list[int]]]:
    """Read the group file: ``user_ns_groups`` and ``item_ns_groups``, name to fids."""
    row = (
        spark.read.text(path, wholetext=True)
        .select(F.from_json("value", GROUPS_TYPE).alias("g"))
        .select("g.*")
        .first()
    )
    return {k: dict(row[k] or {}) for k in ("user_ns_groups", "item_ns_groups")}


def declared_columns(layout: FeatureLayout) -> list[str]:
    """Every raw column the layout reads."""
    cols = [f.column for f in layout.features]
    for d in layout.domains:
        cols += [d.column(fid) for fid, _ in d.fields]
        if d.ts_column:
            cols.append(d.ts_column)
    return cols


def validate_columns(
    df: DataFrame, layout: FeatureLayout, strict: bool = True
) -> FeatureLayout:
    """Check that the declared columns exist.

    Strict mode raises with the missing names. Otherwise the layout comes back without
    the missing features, offsets closed up.
    """
    have = set(df.columns)
    missing = [c for c in declared_columns(layout) if c not in have]
    if not missing:
        return layout
    if strict:
        raise ValueError(f"declared columns are missing: {', '.join(missing)}")
    out = FeatureLayout(())
    for f in layout.features:
        if f.column in have:
            out = out.with_features(f.group, [(f.fid, f.length, f.vocab)])
    domains = []
    for d in layout.domains:
        fields = tuple(x for x in d.fields if d.column(x[0]) in have)
        ts = d.ts_fid if d.ts_column in have else None
        if fields:
            domains.append(replace(d, fields=fields, ts_fid=ts))
    return replace(out, domains=tuple(domains))


def transform_mask(
    position: Column, ranges: Sequence[tuple[int, int]] = UNSCALED_RANGES
) -> Column:
    """True for positions that may be rescaled, false inside the given ranges."""
    mask = F.lit(True)
    for start, end in ranges:
        mask = mask & ~((position >= start) & (position < end))
    return mask


def route_by_cardinality(
    layout: DataFrame,
    threshold: int = DEFAULT_HASH_THRESHOLD,
    hash_buckets: int = DEFAULT_HASH_BUCKETS,
    word2vec_fids: Sequence[tuple[str, int]] = (),
    id_threshold: int = ID_VOCAB_THRESHOLD,
) -> DataFrame:
    """How each feature is embedded: ``word2vec``, ``direct``, ``hash`` or ``skip``.

    ``word2vec_fids`` are ``(group, fid)`` pairs; a threshold of 0 means no limit.
    """
    chosen = F.lit(False)
    for group, fid in word2vec_fids:
        chosen = chosen | ((F.col("group") == group) & (F.col("fid") == fid))
    high = (F.col("vocab") > threshold) if threshold > 0 else F.lit(False)
    route = (
        F.when(chosen, "word2vec")
        .when(F.col("vocab") <= 0, "skip")
        .when(high, "hash" if hash_buckets > 0 else "skip")
        .otherwise("direct")
    )
    return layout.select(
        "*", route.alias("route"), (F.col("vocab") > id_threshold).alias("is_id")
    )
