"""Dense statistics and the bundle that lets scoring repeat the training transform."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.fixed_values import (
    DEFAULT_HASH_BUCKETS,
    DEFAULT_HASH_THRESHOLD,
    DEFAULT_TZ_HOURS,
    HOLIDAYS,
    ITEM_DENSE_BRANCHES,
    UNSCALED_RANGES,
    USER_DENSE_BRANCHES,
)
from tidemark.schema import (
    Feature,
    FeatureLayout,
    SequenceDomain,
    layout_from_text,
    load_feature_schema,
    load_groups,
)

_STATS_TYPE = (
    "feature string, num_dims long, use_dense_value_log1p boolean, stat_scope string,"
    " excluded_ranges array<array<long>>,"
    " mean array<double>, std array<double>, count array<long>"
)


def save_dense_stats(
    stats: DataFrame,
    path: str,
    log1p: bool = True,
    excluded: Sequence[tuple[int, int]] = UNSCALED_RANGES,
) -> None:
    """Statistics of all dimensions as one JSON record with notes on their scope."""
    packed = stats.agg(
        F.sort_array(F.collect_list(F.struct("pos", "mean", "std", "count"))).alias("s")
    )
    record = packed.select(
        F.lit("user_dense").alias("feature"),
        F.size("s").cast("long").alias("num_dims"),
        F.lit(log1p).alias("use_dense_value_log1p"),
        F.lit("observed positions outside the excluded ranges").alias("stat_scope"),
        F.array(*[F.array(F.lit(a), F.lit(b)) for a, b in excluded]).alias("excluded_ranges"),
        *[F.col(f"s.{c}").alias(c) for c in ("mean", "std", "count")],
    )
    record.coalesce(1).write.mode("overwrite").json(path)


def load_dense_stats(
    spark: SparkSession, path: str, expected_dim: int | None = None
) -> DataFrame:
    """Statistics as rows ``(pos, count, mean, std)``; a wrong dimension raises."""
    record = spark.read.schema(_STATS_TYPE).json(path)
    if expected_dim is not None:
        sizes = record.select(F.size("mean").alias("m"), F.size("std").alias("s")).first()
        if sizes is None or tuple(sizes) != (expected_dim, expected_dim):
            raise ValueError(f"dense statistics: expected {expected_dim} dimensions, got {sizes}")
    return record.select(
        F.posexplode(F.arrays_zip("count", "mean", "std")).alias("pos", "e")
    ).select(F.col("pos").cast("long").alias("pos"), "e.count", "e.mean", "e.std")


@dataclass(frozen=True)
class Transform:
    """What training fixes beside the layout and scoring has to repeat.

    ``scaling`` is ``zscore`` (user values by the saved statistics), ``branches`` (value
    transforms of the user and item branches) or ``none``. ``word2vec`` names the ``(group, fid)`` whose ids
    are pooled vectors of ``vector_dim`` values; ``key`` then names the columns that identify a row.
    """

    tz_hours: float = DEFAULT_TZ_HOURS
    holidays: tuple[str, ...] = HOLIDAYS
    calendar: bool = True
    history: bool = True
    scaling: str = "zscore"
    log1p: bool = True
    excluded: tuple[tuple[int, int], ...] = UNSCALED_RANGES
    user_branches: tuple[tuple[str, tuple[int, ...], str], ...] = USER_DENSE_BRANCHES
    item_branches: tuple[tuple[str, tuple[int, ...], str], ...] = ITEM_DENSE_BRANCHES
    hash_threshold: int = DEFAULT_HASH_THRESHOLD
    hash_buckets: int = DEFAULT_HASH_BUCKETS
    word2vec: tuple[tuple[str, int], ...] = ()
    vector_dim: int = 64
    key: tuple[str, ...] = ()


def _tuples(x):
    return tuple(map(_tuples, x)) if isinstance(x, list) else x


@dataclass
class Bundle:
    """Everything that scoring needs."""

    layout: FeatureLayout
    stats: DataFrame | None
    groups: dict[str, dict[str, list[int]]] | None
    vocab: DataFrame | None
    model: PipelineModel | None
    transform: Transform | None = None


def save_bundle(
    spark: SparkSession,
    path: str,
    schema_text: str,
    stats: DataFrame | None = None,
    groups: Mapping[str, Mapping[str, Sequence[int]]] | None = None,
    vocab: DataFrame | None = None,
    model: PipelineModel | None = None,
    layout: FeatureLayout | None = None,
    transform: Transform | None = None,
) -> None:
    """Write schema, statistics, groups, vocabularies, the transform and the model side by side.

    ``layout`` is the one that training used; without it, that of the schema as it stands.
    It is saved resolved, so loading does not derive it again.
    """

    def put(text: str, name: str) -> None:
        one = spark.createDataFrame([(text,)], "value string").coalesce(1)
        one.write.mode("overwrite").text(f"{path}/{name}")

    # One document per line, so that reading the directory as text gives it back.
    put(json.dumps(json.loads(schema_text)), "schema")
    if layout is None:
        layout = layout_from_text(spark.createDataFrame([(schema_text,)], "value string"))
    put(json.dumps(asdict(layout)), "layout")
    if groups is not None:
        put(json.dumps({k: dict(v) for k, v in groups.items()}), "groups")
    if transform is not None:
        put(json.dumps(asdict(transform)), "transform")
    if stats is not None:
        how = transform or Transform()
        save_dense_stats(stats, f"{path}/dense_stats", how.log1p, how.excluded)
    if vocab is not None:
        vocab.write.mode("overwrite").parquet(f"{path}/vocab")
    if model is not None:
        model.write().overwrite().save(f"{path}/model")


def load_layout(spark: SparkSession, path: str) -> FeatureLayout:
    """The resolved layout that ``save_bundle`` wrote."""
    saved = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return FeatureLayout(
        tuple(Feature(**f) for f in saved["features"]),
        tuple(
            SequenceDomain(**{**d, "fields": tuple(tuple(x) for x in d["fields"])})
            for d in saved["domains"]
        ),
    )


def load_transform(spark: SparkSession, path: str) -> Transform:
    """The transform that ``save_bundle`` wrote."""
    saved = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return Transform(**{k: _tuples(v) for k, v in saved.items()})


def load_bundle(
    spark: SparkSession,
    path: str,
    fallback_schema: str | None = None,
    max_lens: Mapping[str, int] | None = None,
) -> Bundle:
    """Read a bundle; the layout saved in it wins over its schema and the ``fallback_schema`` of the data."""

    def optional(read):
        """None where nothing was saved; every other error goes to the caller."""
        try:
            return read()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def load_model():
        spark.read.text(f"{path}/model/metadata")  # tells a missing model from a broken one
        return PipelineModel.load(f"{path}/model")

    layout = optional(lambda: load_layout(spark, f"{path}/layout"))
    if layout is None:
        layout = optional(lambda: load_feature_schema(spark, f"{path}/schema", max_lens=max_lens))
    if layout is None:
        if fallback_schema is None:
            raise FileNotFoundError(f"no schema in {path}")
        layout = load_feature_schema(spark, fallback_schema, max_lens=max_lens)
    dim = layout.total_dim("user_dense")
    return Bundle(
        layout,
        optional(lambda: load_dense_stats(spark, f"{path}/dense_stats", dim)),
        optional(lambda: load_groups(spark, f"{path}/groups")),
        optional(lambda: spark.read.parquet(f"{path}/vocab")),
        optional(load_model),
        optional(lambda: load_transform(spark, f"{path}/transform")),
    )
