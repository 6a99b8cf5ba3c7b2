"""One Spark query per operator, each over whole tables.

Arrays come out as text or one row per position, and doubles rounded to six digits, so
that results compare by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed_values as fixed
from tidemark import schema as sch
from tidemark.functions import arrays, ids, maths, timefeat
from tidemark.operators import (
    assemble,
    chunks,
    dense,
    filters,
    holidays,
    item_history,
    metrics,
    pooling,
    splits,
    vocab,
)
from tidemark.operators.storage import packed, shared_folder, stored
from tidemark.plans import derived_inputs as inputs
from tidemark.plans import examples, item2vec, lifecycle, training
from tidemark.sources import bundle, impressions, sinks

YEAR = 366 * 86400
TOKENS = 60
DIM = inputs.VECTOR_DIM
SCALED_OUT = ((0, 24), (40, 52))

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
    QUERIES[fn.__name__] = fn
    return fn


def num(c: Column | str) -> Column:
    """Six digits, without negative zeros."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < 5e-7, F.lit(0.0)).otherwise(F.round(c, 6))


def text(c: Column | str) -> Column:
    return F.array_join(F.transform(c, lambda x: x.cast("bigint").cast("string")), ",")


def by_position(df: DataFrame, key: list[str], array: str, name: str = "value") -> DataFrame:
    rows = df.select(*key, F.posexplode(array).alias("pos", name))
    return rows.select(*key, F.col("pos").cast("bigint").alias("pos"), num(name).alias(name))


def scratch(spark: SparkSession) -> str:
    """A new folder for what a query writes and reads back."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[num(c).alias(c) if c in columns else F.col(c) for c in df.columns])


# Sources and sinks.


@query
def read_impressions(spark, sf):
    return inputs.impressions(spark, sf)


@query
def project_scan(spark, sf):
    return impressions.project_scan(inputs.item_log(spark, sf), ["item_id", "timestamp"])


@query
def union_files(spark, sf):
    paths = [f"{sf}/labels.parquet", f"{sf}/documents.parquet"]
    df = impressions.union_files(spark, paths)
    return df.select("doc_id", "quality", "n_chars")


@query
def feature_schema(spark, sf):
    return sch.parse_features(inputs.schema_text(spark, sf), dim_overrides={130: 30})


@query
def sequence_schema(spark, sf):
    rows = sch.parse_sequences(
        inputs.schema_text(spark, sf), max_lens=sch.parse_max_lens("seq_a:128,seq_b:64")
    )
    return rows.withColumn("is_ts", F.col("is_ts").cast("int"))


@query
def feature_layout(spark, sf):
    declared = sch.parse_features(inputs.schema_text(spark, sf), dim_overrides={})
    positions = declared.select(
        "group", "slot", "fid", "vocab", F.explode(F.sequence(F.lit(1), "length")).alias("p")
    )
    return sch.feature_layout(sch.positions_to_features(positions))


@query
def validate_columns(spark, sf):
    df = inputs.ids(spark, sf)
    wide = inputs.LAYOUT.with_features("user_int", [(5, 2, 9)])
    raw = df.columns
    layout = sch.validate_columns(
        df, sch.FeatureLayout(tuple(f for f in wide.features if f.group == "user_int")), strict=False
    )
    assert len(raw) > len(layout.features)
    return df.select("event_id", text(assemble.int_vector(layout, "user_int")).alias("user_int"))


@query
def write_examples(spark, sf):
    rows = inputs.ids(spark, sf).select(
        "event_id",
        "timestamp",
        assemble.int_vector(inputs.LAYOUT, "user_int").alias("user_int_feats"),
        F.when(F.col("event_id") >= 0, "all").alias("split"),
    )
    path = scratch(spark)
    sinks.write_examples(rows, path, shards=4)
    return spark.read.parquet(path).select(
        "event_id", "timestamp", text("user_int_feats").alias("user_int"), "split"
    )


@query
def write_balanced(spark, sf):
    path = scratch(spark)
    sinks.write_balanced(inputs.impressions(spark, sf, with_position=True), path, 7, chunk_rows=300)
    return spark.read.parquet(path).groupBy(F.col("shard").cast("bigint").alias("shard")).agg(
        F.count("*").alias("rows"), F.sum("event_id").alias("events")
    )


def _probabilities(spark, sf) -> DataFrame:
    return inputs.scored(spark, sf, with_position=True).withColumn(
        "prob", maths.sigmoid(F.col("logit"))
    )


@query
def latest_predictions(spark, sf):
    return rounded(sinks.latest_predictions(_probabilities(spark, sf)), "prob")


@query
def write_predictions(spark, sf):
    path = scratch(spark)
    sinks.write_predictions(_probabilities(spark, sf), path)
    saved = spark.read.schema("user_id bigint, prob double").json(path)
    return rounded(saved, "prob")


def _dense_rows(spark, sf) -> DataFrame:
    values, presence = assemble.dense_vector_with_presence(inputs.LAYOUT, "user_dense")
    return inputs.dense(spark, sf).select(
        "vec_id", "label", values.alias("values"), presence.alias("presence")
    )


def _dense_stats(spark, sf) -> DataFrame:
    return dense.dense_stats(
        _dense_rows(spark, sf), "values", "presence", log1p=True, excluded=SCALED_OUT
    )


@query
def dense_stats_saved(spark, sf):
    path = scratch(spark)
    bundle.save_dense_stats(_dense_stats(spark, sf), path, excluded=SCALED_OUT)
    saved = bundle.load_dense_stats(spark, path, inputs.LAYOUT.total_dim("user_dense"))
    return rounded(saved, "mean", "std")


@query
def bundle_saved(spark, sf):
    path = scratch(spark)
    document = inputs.schema_text(spark, sf).first()["value"]
    saved = bundle.Transform(tz_hours=5.5, word2vec=(("seq_a", 38),), key=("event_id",))
    groups = {"user_ns_groups": inputs.GROUPS}
    bundle.save_bundle(spark, path, document, groups=groups, transform=saved)
    loaded = bundle.load_bundle(spark, path)
    layout, how = loaded.layout, loaded.transform
    sequence = assemble.build_sequence(layout.domain("seq_a"))
    ids_of = assemble.group_ids(assemble.int_vector(layout, "user_int"), layout, "user_int", loaded.groups["user_ns_groups"])
    return inputs.whole_log(spark, sf).select(
        "event_id",
        text(assemble.int_vector(layout, "user_int")).alias("user_int"),
        text(assemble.int_vector(layout, "item_int")).alias("item_int"),
        text(ids_of["U2"]).alias("second_group"),
        F.size(assemble.dense_vector(layout, "user_dense")).cast("bigint").alias("user_dense"),
        F.size(assemble.dense_vector(layout, "item_dense")).cast("bigint").alias("item_dense"),
        text(sequence["seq_a_38"]).alias("items"),
        text(sequence["seq_a_39"]).alias("actions"),
        F.lit(f"{how.tz_hours} {how.scaling} {how.word2vec} {len(how.holidays)}").alias("transform"),
    )


# Filters and ids.


@query
def filter_time_range(spark, sf):
    lo, hi = 1704412800, 1705622400
    return filters.filter_time_range(inputs.impressions(spark, sf), lo, hi).select(
        "event_id", "timestamp"
    )


@query
def derive_label(spark, sf):
    return inputs.impressions(spark, sf).select(
        "event_id",
        ids.derive_label(F.col("label_type")).alias("label"),
        ids.derive_label(F.col("label_type"), training=False).alias("label_scoring"),
    )


@query
def clean_id(spark, sf):
    c = F.col("user_int_feats_1")
    return inputs.ids(spark, sf).select(
        "event_id", ids.clean_id(c, 40).alias("kept"), ids.clean_id(c, 0).alias("no_vocab")
    )


@query
def assert_in_vocab(spark, sf):
    layout = sch.FeatureLayout(()).with_features(
        "user_int", [(1, 1, 46), (3, 4, 100)]
    ).with_features("item_int", [(11, 1, 101)])
    return filters.assert_in_vocab(inputs.ids(spark, sf), layout).select("event_id", "item_id")


@query
def oob_report(spark, sf):
    layout = sch.FeatureLayout(inputs.LAYOUT.features)
    return filters.oob_report(inputs.ids(spark, sf), layout)


@query
def oob_report_sequences(spark, sf):
    domain = sch.SequenceDomain("seq_a", "seq_a", 9, ((38, 90), (39, 3)), 256)
    return filters.oob_report(inputs.histories(spark, sf), sch.FeatureLayout((), (domain,)))


@query
def drop_nan_scores(spark, sf):
    scored = inputs.scored(spark, sf, with_nan=True)
    return rounded(filters.drop_nan_scores(scored, "logit"), "logit")


@query
def nan_score_count(spark, sf):
    return filters.nan_score_count(inputs.scored(spark, sf, with_nan=True), "logit")


# Arrays.


@query
def pad_int_list(spark, sf):
    c = F.col("user_int_feats_3")
    return inputs.ids(spark, sf).select(
        "event_id",
        text(arrays.pad_int_list(c, 4)).alias("short"),
        text(arrays.pad_int_list(c, 7)).alias("long"),
        arrays.list_length(c, 4).cast("bigint").alias("length"),
    )


@query
def pad_float_list(spark, sf):
    finite = F.transform("user_dense_feats_62", lambda x: F.when(~F.isnan(x) & (x < 1e9), x))
    df = inputs.dense(spark, sf).select(
        "vec_id", arrays.pad_float_list(F.filter(finite, lambda x: x.isNotNull()), 18).alias("v")
    )
    return by_position(df, ["vec_id"], "v")


@query
def pad_float_list_with_presence(spark, sf):
    values, presence = arrays.pad_float_list_with_presence(F.col("user_dense_feats_61"), 26)
    df = inputs.dense(spark, sf).select(
        "vec_id", F.posexplode(F.arrays_zip(values.alias("v"), presence.alias("p"))).alias("pos", "e")
    )
    return df.select(
        "vec_id",
        F.col("pos").cast("bigint").alias("pos"),
        num("e.v").alias("value"),
        num("e.p").alias("presence"),
    )


@query
def segment_presence(spark, sf):
    return _dense_rows(spark, sf).select(
        "vec_id",
        num(arrays.segment_presence(arrays.take_range(F.col("presence"), 0, 24))).alias("head"),
        num(arrays.segment_presence(arrays.take_range(F.col("presence"), 64, 70))).alias("tail"),
    )


@query
def append_presence(spark, sf):
    df = _dense_rows(spark, sf).select(
        "vec_id", arrays.append_presence(F.col("values"), F.col("presence")).alias("v")
    )
    return by_position(df, ["vec_id"], "v")


@query
def append_segment_presence(spark, sf):
    df = _dense_rows(spark, sf).select(
        "vec_id", arrays.append_segment_presence(F.col("values"), F.col("presence")).alias("v")
    )
    return by_position(df, ["vec_id"], "v")


@query
def take_range(spark, sf):
    df = _dense_rows(spark, sf).select(
        "vec_id", arrays.take_range(F.col("values"), 40, 80).alias("v")
    )
    return by_position(df, ["vec_id"], "v")


@query
def assemble_int_vector(spark, sf):
    return inputs.ids(spark, sf).select(
        "event_id",
        text(assemble.assemble_vector(inputs.LAYOUT, "user_int")).alias("user_int"),
        text(assemble.assemble_vector(inputs.LAYOUT, "item_int")).alias("item_int"),
    )


@query
def assemble_dense_vector(spark, sf):
    return by_position(_dense_rows(spark, sf), ["vec_id"], "values")


def _branches(spark, sf, transform: bool) -> DataFrame:
    b = assemble.branch_vectors(
        F.col("values"), inputs.LAYOUT, "user_dense", inputs.BRANCHES, transform
    )
    df = _dense_rows(spark, sf).select("vec_id", b.alias("b")).select("vec_id", "b.*")
    out = [
        by_position(df, ["vec_id"], name).withColumn("branch", F.lit(name))
        for name in df.columns[1:]
    ]
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    return whole


@query
def branch_vectors(spark, sf):
    return _branches(spark, sf, transform=False)


@query
def apply_branch_transform(spark, sf):
    return _branches(spark, sf, transform=True)


@query
def group_ids(spark, sf):
    v = assemble.int_vector(inputs.LAYOUT, "user_int")
    return inputs.ids(spark, sf).select(
        "event_id",
        assemble.group_ids(v, inputs.LAYOUT, "user_int", inputs.GROUPS).alias("g"),
        assemble.group_ids(v, inputs.LAYOUT, "user_int").alias("s"),
    ).select(
        "event_id",
        text("g.U1").alias("u1"),
        text("g.U2").alias("u2"),
        text("s.1").alias("single_1"),
        text("s.3").alias("single_3"),
    )


@query
def build_sequence(spark, sf):
    return inputs.histories(spark, sf).select(
        "event_id", assemble.build_sequence(inputs.SEQ_A).alias("s")
    ).select("event_id", text("s.seq_a_38").alias("items"), text("s.seq_a_39").alias("actions"))


@query
def sequence_length(spark, sf):
    return inputs.histories(spark, sf).select(
        "event_id", assemble.build_sequence_length(inputs.SEQ_A).cast("bigint").alias("length")
    )


@query
def padding_mask(spark, sf):
    mask = arrays.padding_mask(assemble.build_sequence_length(inputs.SEQ_A), 256)
    return inputs.histories(spark, sf).select(
        "event_id", text(F.transform(mask, lambda m: m.cast("int"))).alias("mask")
    )


@query
def most_recent_k(spark, sf):
    length = assemble.build_sequence_length(inputs.SEQ_A)
    padded = assemble.raw_sequence(inputs.SEQ_A, 38)
    mask = arrays.most_recent_k_mask(length, 20)
    return inputs.histories(spark, sf).select(
        "event_id",
        text(arrays.most_recent_k(padded, length, 20)).alias("items"),
        text(F.transform(mask, lambda m: m.cast("int"))).alias("mask"),
    )


@query
def valid_tokens(spark, sf):
    df = vocab.sentences(
        inputs.histories(spark, sf, with_position=True), "seq_a_39", max_len=15
    )
    return df.select(F.col("src_row").alias("event_id"), text("tokens").alias("tokens"))


# Dates and times.


def _calendar(c: Column) -> list[Column]:
    return [c.getField(n).alias(n) for n in ("hour", "weekday", "period")]


@query
def calendar_ids(spark, sf):
    return inputs.impressions(spark, sf).select(
        "event_id", *_calendar(timefeat.calendar_ids(F.col("timestamp")))
    )


@query
def calendar_ids_half_hour_zone(spark, sf):
    return inputs.impressions(spark, sf).select(
        "event_id", *_calendar(timefeat.calendar_ids(F.col("timestamp"), -3.5))
    )


@query
def day_type(spark, sf):
    d = timefeat.day_type(F.col("timestamp") + YEAR)
    return inputs.impressions(spark, sf).select(
        "event_id", *[d.getField(n).alias(n) for n in ("weekend", "holiday")]
    )


def _times(spark, sf) -> DataFrame:
    return inputs.histories(spark, sf).select(
        "event_id", "timestamp", assemble.sequence_times(inputs.SEQ_A).alias("times")
    )


@query
def calendar_ids_seq(spark, sf):
    df = _times(spark, sf).select("event_id", timefeat.calendar_ids_seq(F.col("times"), pad_to=256).alias("c"))
    return df.select("event_id", *[text(f"c.{n}").alias(n) for n in ("hour", "weekday", "period")])


@query
def day_type_seq(spark, sf):
    shifted = F.transform("times", lambda t: F.when(t > 0, t + YEAR).otherwise(t))
    df = _times(spark, sf).select("event_id", timefeat.day_type_seq(shifted, pad_to=256).alias("d"))
    return df.select("event_id", text("d.weekend").alias("weekend"), text("d.holiday").alias("holiday"))


@query
def recency_bucket(spark, sf):
    b = timefeat.recency_bucket_seq(F.col("timestamp"), F.col("times"), pad_to=256)
    return _times(spark, sf).select("event_id", text(b).alias("buckets"))


@query
def cyclical_time(spark, sf):
    c = timefeat.calendar_ids(F.col("timestamp"))
    df = inputs.impressions(spark, sf).select(
        "event_id", timefeat.cyclical_time(c.getField("hour"), c.getField("weekday")).alias("v")
    )
    return by_position(df, ["event_id"], "v")


@query
def append_calendar(spark, sf):
    c = timefeat.calendar_ids(F.col("timestamp"))
    value = F.array(F.col("user_int_feats_2").cast("double"))
    df = inputs.ids(spark, sf).select(
        "event_id",
        assemble.append_calendar_ids(assemble.int_vector(inputs.LAYOUT, "user_int"), c).alias("u"),
        assemble.append_calendar_ids(assemble.int_vector(inputs.LAYOUT, "item_int"), c).alias("i"),
        assemble.append_calendar_dense(value, c).alias("d"),
    )
    return df.select(
        "event_id",
        text("u").alias("user_int"),
        text("i").alias("item_int"),
        *[num(F.get("d", F.lit(i))).alias(f"d{i}") for i in range(5)],
    )


# Values.


@query
def signed_log1p(spark, sf):
    logit = inputs.scored(spark, sf)
    return logit.select("event_id", num(maths.signed_log1p(F.col("logit"))).alias("y"))


@query
def log1p_nonneg(spark, sf):
    logit = inputs.scored(spark, sf)
    return logit.select("event_id", num(maths.log1p_nonneg(F.col("logit"))).alias("y"))


@query
def sigmoid(spark, sf):
    logit = inputs.scored(spark, sf)
    return logit.select("event_id", num(maths.sigmoid(F.col("logit"))).alias("y"))


@query
def safe_ratio(spark, sf):
    ratio = maths.safe_ratio(F.col("value"), F.col("item_id") - 50)
    return inputs.impressions(spark, sf).select("event_id", ratio.alias("y"))


@query
def transform_mask(spark, sf):
    layout = sch.parse_features(inputs.schema_text(spark, sf), dim_overrides={130: 30})
    total = layout.where(F.col("group") == "user_dense").agg(F.sum("length").alias("n"))
    pos = total.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos"))
    mask = sch.transform_mask(F.col("pos"), SCALED_OUT)
    return pos.select("pos", mask.cast("int").alias("scaled"))


@query
def zscore_apply(spark, sf):
    df = dense.zscore_apply(
        _dense_rows(spark, sf), "values", "presence", _dense_stats(spark, sf), excluded=SCALED_OUT
    )
    return by_position(df, ["vec_id"], "values")


@query
def hash_bucket(spark, sf):
    return inputs.ids(spark, sf).select(
        "event_id", ids.hash_bucket(F.coalesce("user_int_feats_1", F.lit(0)), 7).alias("bucket")
    )


@query
def route_by_cardinality(spark, sf):
    layout = sch.feature_layout(
        sch.parse_features(inputs.schema_text(spark, sf), dim_overrides={})
    ).where(F.col("group").isin("user_int", "item_int"))
    routed = sch.route_by_cardinality(
        layout, threshold=60, hash_buckets=50, word2vec_fids=[("item_int", 11)], id_threshold=45
    )
    return routed.select("group", "fid", "vocab", "route", F.col("is_id").cast("int").alias("is_id"))


# Item history and other aggregates.


@query
def item_core_stats(spark, sf):
    return item_history.item_core_stats(inputs.item_log(spark, sf))


@query
def item_hour_counts(spark, sf):
    return item_history.item_hour_counts(inputs.impressions(spark, sf)).select(
        "item_id", "hour", "cnt"
    )


@query
def item_day_counts(spark, sf):
    return item_history.item_day_counts(inputs.impressions(spark, sf))


@query
def item_active_buckets(spark, sf):
    return item_history.item_active_buckets(inputs.impressions(spark, sf))


@query
def item_trailing_counts(spark, sf):
    return item_history.item_trailing_counts(inputs.impressions(spark, sf))


@query
def item_peak_ratio(spark, sf):
    return rounded(item_history.item_peak_ratio(inputs.impressions(spark, sf)), "peak_ratio")


@query
def item_alive_recency(spark, sf):
    df = item_history.item_alive_recency(inputs.item_log(spark, sf))
    return rounded(df, "alive_hours", "recency_hours")


@query
def item_trend(spark, sf):
    return rounded(item_history.item_trend(inputs.impressions(spark, sf)), "trend")


@query
def bucket_entropy(spark, sf):
    df = item_history.bucket_entropy(inputs.impressions(spark, sf))
    return rounded(df, "hour_entropy", "day_entropy")


@query
def item_history_features(spark, sf):
    df = item_history.item_history(inputs.impressions(spark, sf))
    return rounded(df, *fixed.ITEM_HISTORY_NAMES)


@query
def item_history_large(spark, sf):
    return rounded(item_history.item_history(inputs.item_log(spark, sf)), *fixed.ITEM_HISTORY_NAMES)


@query
def item_history_in_range(spark, sf):
    df = item_history.item_history(inputs.impressions(spark, sf), (1704412800, 1705622400))
    return rounded(df, *fixed.ITEM_HISTORY_NAMES)


@query
def dense_stats(spark, sf):
    return rounded(_dense_stats(spark, sf), "mean", "std")


@query
def token_frequency(spark, sf):
    s = vocab.sentences(inputs.histories(spark, sf), "seq_a_38", max_len=200)
    return vocab.token_frequency(s, min_count=5)


@query
def auc(spark, sf):
    df = inputs.scored(spark, sf).withColumn("prob", maths.sigmoid(F.col("logit")))
    return rounded(metrics.auc(df, "prob", "label"), "auc")


@query
def logloss(spark, sf):
    return rounded(metrics.logloss(inputs.scored(spark, sf), "logit", "label"), "logloss")


@query
def focal_loss(spark, sf):
    return rounded(metrics.focal_loss(inputs.scored(spark, sf)), "focal_loss")


@query
def focal_loss_per_row(spark, sf):
    df = metrics.focal_loss(inputs.scored(spark, sf), alpha=0.25, gamma=1.5, reduction="none")
    return rounded(df.select("event_id", "focal_loss"), "focal_loss")


@query
def pairwise_auc_loss(spark, sf):
    df = metrics.pairwise_auc_loss(inputs.scored(spark, sf), "event_id", block_rows=1000)
    return rounded(df, "loss")


@query
def contrastive_loss(spark, sf):
    df = metrics.contrastive_loss(inputs.vectors(spark, sf), "vec_id", block_rows=100)
    return rounded(df, "loss")


@query
def contrastive_loss_positives(spark, sf):
    df = metrics.contrastive_loss(
        inputs.vectors(spark, sf), "vec_id", block_rows=100, positives_only=True
    )
    return rounded(df, "loss")


def _training_end(imp) -> int:
    """Four fifths of the log's time span."""
    lo, hi = imp.agg(F.min("timestamp"), F.max("timestamp")).first()
    return lo + (hi - lo) * 4 // 5


@query
def coverage(spark, sf):
    imp = inputs.impressions(spark, sf)
    known = item_history.item_history(imp, (None, _training_end(imp)))
    df = item_history.attach_item_history(imp, known, matched="hit")
    return rounded(item_history.coverage(df, "hit"), "coverage")


@query
def split_sizes(spark, sf):
    df = splits.split_by_position(
        inputs.impressions(spark, sf, with_position=True), 0.25, chunk_rows=300
    ).withColumn("chunk", F.floor(F.col("src_row") / 300))
    return splits.split_sizes(df, 128, ["src_file", "chunk"])


# Lookups.


@query
def attach_item_history(spark, sf):
    imp = inputs.impressions(spark, sf)
    known = item_history.item_history(imp, (None, _training_end(imp)))
    df = item_history.attach_item_history(imp.select("event_id", "item_id"), known)
    return rounded(df, *fixed.ITEM_HISTORY_NAMES)


@query
def attach_item_history_large(spark, sf):
    log = inputs.item_log(spark, sf)
    table = item_history.item_history(log)
    names = fixed.ITEM_HISTORY_NAMES
    df = item_history.attach_item_history(log.select("order_id", "line_no", "item_id"), table)
    return rounded(df, *names)


def _vocab(spark, sf, rows: DataFrame | None = None) -> DataFrame:
    s = vocab.sentences(rows or inputs.histories(spark, sf), "seq_a_38", max_len=200)
    return vocab.top_k_vocab(vocab.token_frequency(s, min_count=5), TOKENS)


@query
def top_k_vocab(spark, sf):
    return _vocab(spark, sf)


@query
def compact_ids(spark, sf):
    rows = stored(inputs.histories(spark, sf).select(*inputs.HISTORY_KEY, "seq_a_38"))
    df = vocab.compact_ids(rows, inputs.HISTORY_KEY, "seq_a_38", _vocab(spark, sf, rows))
    return df.select("event_id", text("seq_a_38").alias("items"))


@query
def compact_ids_many(spark, sf):
    """Items and actions of the histories and the ids of the event, each with its own vocabulary, in one pass."""
    lists = inputs.whole_log(spark, sf)
    columns = {"seq_a_38": "seq_a_38", "seq_a_39": "seq_a_39", "user_int_feats_3": "user_int_3"}
    rows = stored(lists.select("event_id", *columns))
    known = [
        vocab.top_k_vocab(vocab.token_frequency(vocab.sentences(rows, c), min_count=5), k).select(
            F.lit(f).alias("feature"), "raw_id", "compact_id"
        )
        for (c, f), k in zip(columns.items(), (TOKENS, 2, 30), strict=True)
    ]
    df = vocab.compact_ids_many(rows, ["event_id"], columns, known[0].unionByName(known[1]).unionByName(known[2]))
    return df.select("event_id", *[text(c).alias(c) for c in columns])


@query
def compact_ids_shuffled(spark, sf):
    df = vocab.compact_ids(
        inputs.ids(spark, sf), ["event_id"], "user_int_feats_3", _vocab(spark, sf)
    )
    return df.select("event_id", text("user_int_feats_3").alias("items"))


def _known_vectors(spark, sf, rows: DataFrame | None = None) -> DataFrame:
    v = inputs.vectors(spark, sf).select(F.col("vec_id").alias("raw_id"), "vector")
    return v.join(_vocab(spark, sf, rows), "raw_id").select("raw_id", "vector")


@query
def embed_mean_pool(spark, sf):
    df = inputs.ids(spark, sf).select(
        "event_id", arrays.pad_id_list(F.col("user_int_feats_3"), 4, 60).alias("ids")
    )
    pooled = pooling.embed_mean_pool(
        df, ["event_id"], "ids", _known_vectors(spark, sf), DIM
    )
    return by_position(pooled, ["event_id"], "pooled")


def _pool_input(rows: DataFrame) -> DataFrame:
    times = assemble.sequence_times(inputs.SEQ_A)
    return rows.select(
        *inputs.HISTORY_KEY,
        F.slice("seq_a_38", 1, inputs.SEQ_A.max_len).alias("ids"),
        timefeat.recency_bucket_seq(F.col("timestamp"), times).alias("buckets"),
        assemble.build_sequence_length(inputs.SEQ_A).alias("length"),
    )


@query
def sequence_mean_pool(spark, sf):
    rows = stored(inputs.histories(spark, sf))
    pooled = pooling.sequence_mean_pool(
        _pool_input(rows), inputs.HISTORY_KEY, "ids", "length",
        _known_vectors(spark, sf, rows), DIM,
    )
    return by_position(pooled, ["event_id"], "pooled")


@query
def time_decay_pool(spark, sf):
    rows = stored(inputs.histories(spark, sf))
    pooled = pooling.time_decay_pool(
        _pool_input(rows), inputs.HISTORY_KEY, "ids", "buckets", "length",
        _known_vectors(spark, sf, rows), DIM, 0.1,
    )
    return by_position(pooled, ["event_id"], "pooled")


@query
def holiday_lookup(spark, sf):
    orders = impressions.read_impressions(spark, f"{sf}/orders.parquet")
    urgent = orders.where(F.col("o_orderpriority") == "1-URGENT")
    days = urgent.select(F.col("o_orderdate").cast("date").alias("day"))
    df = holidays.holiday_lookup(
        inputs.item_log(spark, sf), days, "1992-01-01", "2002-12-31", tz_hours=0
    )
    return df.select("order_id", "line_no", "holiday")


@query
def range_lookup(spark, sf):
    imp = inputs.impressions(spark, sf)
    newest = item_history.last_timestamp(imp)
    hour = timefeat.calendar_ids(F.col("timestamp")).getField("hour") - 1
    return imp.select(
        "event_id",
        timefeat.recency_bucket(newest, F.col("timestamp")).alias("age_bin"),
        timefeat.bin_index(hour, fixed.DAY_PERIOD_EDGES, closed="left").alias("day_part"),
    )


# Splits.


@query
def split_by_position(spark, sf):
    df = splits.split_by_position(
        inputs.impressions(spark, sf, with_position=True), 0.1, chunk_rows=700
    )
    return df.select("event_id", "split")


@query
def split_by_position_part(spark, sf):
    df = splits.split_by_position(
        inputs.impressions(spark, sf, with_position=True), 0.1, train_ratio=0.5, chunk_rows=700
    )
    return df.select("event_id", "split")


@query
def split_by_position_compat(spark, sf):
    df = splits.split_by_position(
        inputs.impressions(spark, sf, with_position=True),
        0.1,
        train_ratio=0.5,
        chunk_rows=700,
        reference_compat=True,
    )
    return df.select("event_id", "split")


@query
def split_by_time(spark, sf):
    return splits.split_by_time(inputs.impressions(spark, sf), 0.1).select("event_id", "split")


@query
def time_cutoff(spark, sf):
    return splits.time_cutoff(inputs.item_log(spark, sf), 0.3)


@query
def shuffle_examples(spark, sf):
    df = splits.shuffle_examples(inputs.impressions(spark, sf), ["event_id"], 42, 8)
    return df.select("event_id", "user_id")


@query
def shuffle_in_windows(spark, sf):
    df = chunks.shuffle_in_windows(inputs.impressions(spark, sf, with_position=True), 32, 42, pass_no=3)
    return df.select("event_id", "batch", "place")


@query
def limit_sentences(spark, sf):
    s = vocab.sentences(inputs.histories(spark, sf, with_position=True), "seq_a_39", 200)
    return vocab.limit_sentences(s, 777).select(
        F.col("src_row").alias("event_id"), F.size("tokens").cast("bigint").alias("n")
    )


# Learning and scoring.


@query
def histories(spark, sf):
    return inputs.histories(spark, sf).select(
        "event_id",
        text("seq_a_38").alias("items"),
        text("seq_a_39").alias("actions"),
        text("seq_a_9").alias("times"),
    )


@query
def fit_item2vec(spark, sf):
    df = item2vec.fit_item2vec(
        inputs.histories(spark, sf, with_position=True), "seq_a_38", dim=8
    )
    return df.select("raw_id", "compact_id", F.size("vector").cast("bigint").alias("dim"))


@query
def item2vec_pairs(spark, sf):
    rows = vocab.sentences(inputs.histories(spark, sf), "seq_a_38")
    rows = stored(rows.withColumn("feature", F.lit("seq_a_38")))
    pairs = item2vec.window_pairs(rows, 5)
    return rounded(item2vec.shifted_pmi(pairs, 2.0), "pmi")


@query
def fit_item2vec_many(spark, sf):
    df = item2vec.fit_item2vec_many(
        inputs.histories(spark, sf, with_position=True),
        [("seq_a", 38, "seq_a_38"), ("item", 11, "item_id")],
        dim=4,
    )
    return df.select("feature", "raw_id", "compact_id", F.size("vector").cast("bigint").alias("dim"))


def _model_rows(spark, sf) -> DataFrame:
    imp = inputs.impressions(spark, sf)
    table = item_history.item_history(imp)
    c = timefeat.calendar_ids(F.col("timestamp"))
    df = item_history.attach_item_history(imp, table)
    cyclic = timefeat.cyclical_time(c.getField("hour"), c.getField("weekday"))
    return df.select(
        "event_id",
        "user_id",
        ids.derive_label(F.col("label_type")).alias("label"),
        F.concat(item_history.history_vector(), cyclic, F.array(maths.log1p_nonneg(F.col("value")))).alias(
            "features"
        ),
    )


@query
def fit_and_score(spark, sf):
    rows = _model_rows(spark, sf)
    model = training.fit_classifier(rows, "features", "label", maxIter=500)
    scored = training.score(rows, model, "features")
    return rounded(scored.select("event_id", "label", "prob", "logit"), "prob", "logit")


#: Ids above 50 are hashed, items of the history are pooled vectors, user values are scaled.
WHOLE = bundle.Transform(
    excluded=SCALED_OUT, hash_threshold=50, hash_buckets=16, word2vec=(("seq_a", 38),), vector_dim=8, key=("event_id",)
)


@query
def train_and_evaluate(spark, sf):
    """Every group of the layout and its sequence: one-hot, hashed, pooled and scaled columns."""
    log = packed(inputs.whole_log(spark, sf))
    _, result = lifecycle.train_design(log, inputs.LAYOUT, WHOLE, valid_ratio=0.2, maxIter=500, regParam=0.01)
    return rounded(result, "auc", "logloss")


@query
def predict_as_trained(spark, sf):
    """Whether a bundle that was saved and loaded scores each row as the trained model in memory does."""
    log = packed(inputs.whole_log(spark, sf, with_position=True))
    trained = lifecycle.fit_design(log, inputs.LAYOUT, WHOLE, maxIter=500, regParam=0.01)
    path = scratch(spark)
    trained.save(path, inputs.schema_text(spark, sf).first()["value"])
    place = [*inputs.POSITION]
    again = lifecycle.predict(log.drop("label_type"), bundle.load_bundle(spark, path))
    first = trained.score(log, ("event_id", *place)).select("event_id", *place, F.col("prob").alias("first"))
    both = first.join(again, place)
    return both.select("event_id", (F.abs(F.col("first") - F.col("prob")) < 1e-12).cast("int").alias("same"))


@query
def design_columns(spark, sf):
    """Rows and sum of every column of the sparse design."""
    how = bundle.Transform(history=False, scaling="none", hash_threshold=50, hash_buckets=16)
    rows = lifecycle.design_rows(inputs.whole_log(spark, sf), inputs.LAYOUT, how, keep=("event_id",))
    values = rows.select(F.posexplode(vector_to_array("features")).alias("pos", "v")).where("abs(v) > 1e-9")
    sums = values.groupBy(F.col("pos").cast("bigint").alias("pos")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    return rounded(sums, "total")


#: One hashed feature and nothing else: without a penalty the fit gives every bucket its observed
#: share of conversions, which SQL can count.
GROUPED = bundle.Transform(calendar=False, history=False, scaling="none", hash_threshold=10, hash_buckets=6)
ONE_FEATURE = sch.FeatureLayout(()).with_features("user_int", [(1, 1, 40)])
EXACT = {"maxIter": 1000, "tol": 1e-14}


def four(c: str) -> Column:
    return F.round(F.col(c), 4).alias(c)


@query
def fit_and_score_groups(spark, sf):
    rows = inputs.ids(spark, sf)
    trained = lifecycle.fit_design(rows, ONE_FEATURE, GROUPED, **EXACT)
    scored = trained.score(rows, ("event_id",), training=True)
    return scored.select("event_id", "label", four("prob"), four("logit"))


@query
def train_and_evaluate_groups(spark, sf):
    _, result = lifecycle.train_design(inputs.ids(spark, sf), ONE_FEATURE, GROUPED, valid_ratio=0.2, **EXACT)
    return result.select(four("auc"), four("logloss"))


@query
def predict_groups(spark, sf):
    """Train on the earlier part, save, load, score all rows: each user's last prediction."""
    log = inputs.ids(spark, sf, with_position=True)
    trained, _ = lifecycle.train_design(log, ONE_FEATURE, GROUPED, valid_ratio=0.2, **EXACT)
    path = scratch(spark)
    trained.save(path, '{"user_int": [[1, 40, 1]]}')
    scored = lifecycle.predict(log.drop("label_type"), bundle.load_bundle(spark, path))
    return sinks.latest_predictions(scored).select("user_id", four("prob"))


@query
def evaluate(spark, sf):
    df = metrics.evaluate(inputs.scored(spark, sf, with_nan=True))
    return rounded(df, "auc", "logloss")


@query
def build_examples(spark, sf):
    table = item_history.item_history(inputs.impressions(spark, sf))
    log = inputs.whole_log(spark, sf)
    df = examples.build_examples(log, inputs.LAYOUT, table, keep=("event_id", "user_id", "item_id"))
    values = F.slice("user_dense_feats", 1, 70)
    return df.select(
        "event_id",
        "label",
        text("user_int_feats").alias("user_int"),
        text("item_int_feats").alias("item_int"),
        text(F.transform(values, lambda x: F.floor(x * 10000))).alias("user_dense"),
        *[num(F.get("user_dense_feats", F.lit(70 + i))).alias(f"c{i}") for i in range(4)],
        num(F.get("item_dense_feats", F.lit(0))).alias("d129"),
        *[num(F.get("item_dense_feats", F.lit(i + 1))).alias(f"h{i}") for i in range(12)],
        F.col("time_feats.hour").cast("bigint").alias("now_hour"),
        text("seq_a.seq_a_38").alias("seq_items"),
        text("seq_a.seq_a_39").alias("seq_actions"),
        F.col("seq_a_len").cast("bigint").alias("seq_len"),
        text("seq_a_time_bucket").alias("seq_buckets"),
        text("seq_a_time_feats.hour").alias("seq_hours"),
        text("seq_a_time_feats.weekday").alias("seq_weekdays"),
        text("seq_a_time_feats.period").alias("seq_periods"),
        text("seq_a_day_type_feats.weekend").alias("seq_weekends"),
        text("seq_a_day_type_feats.holiday").alias("seq_holidays"),
    )
