"""Impression-shaped views over the star-schema tables.

The tables hold flat events, line items and embeddings. The views give them the shape
the operators expect: impressions with ids, dense lists, behaviour histories and scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ids import derive_label
from tidemark.plans.histories import build_histories
from tidemark.schema import FeatureLayout, SequenceDomain
from tidemark.sources.impressions import read_impressions

SEQ_A = SequenceDomain("seq_a", "seq_a", 9, ((38, 101), (39, 4)), 256)

LAYOUT = (
    FeatureLayout((), (SEQ_A,))
    .with_features("user_int", [(1, 1, 40), (2, 1, 0), (3, 4, 60)])
    .with_features("item_int", [(11, 1, 101)])
    .with_features("user_dense", [(61, 24, 0), (62, 16, 0), (130, 30, 0)])
    .with_features("item_dense", [(129, 1, 0)])
)
GROUPS = {"U1": [1, 2], "U2": [3]}
BRANCHES = (
    ("ud_fid61", (61,), "raw"),
    ("ud_counts", (62, 63), "log1p_nonneg"),
    ("ud_score", (130, 131), "signed_log1p"),
    ("ud_absent", (87,), "raw"),
)
VECTOR_DIM = 64
POSITION = ("src_file", "src_row")


def wall_seconds(ts: Column) -> Column:
    """Whole Unix seconds of a zone-free timestamp, independent of the session zone."""
    day = F.unix_date(ts.cast("date")).cast("long")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))


def _k() -> Column:
    return F.regexp_extract("props", r"\d+", 0).cast("long")


def impressions(spark: SparkSession, sf_dir: str, with_position: bool = False) -> DataFrame:
    """One row per event: user, item, time, label type, and on demand its place in the file."""
    events = read_impressions(spark, f"{sf_dir}/events.parquet", with_position)
    label_type = (
        F.when(F.col("event_type") == "purchase", 2)
        .when(F.col("event_type") == "click", 1)
        .when(F.col("event_type") == "view", 0)
    )
    return events.select(
        "event_id",
        "user_id",
        (_k() + 1).alias("item_id"),
        wall_seconds(F.col("ts")).alias("timestamp"),
        label_type.alias("label_type"),
        "value",
        *(POSITION if with_position else ()),
    )


def item_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items and days of the line items, a larger log for the item history."""
    lineitem = read_impressions(spark, f"{sf_dir}/lineitem.parquet")
    return lineitem.select(
        F.col("l_partkey").alias("item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line_no"),
        wall_seconds(F.col("l_shipdate")).alias("timestamp"),
    )


def ids(spark: SparkSession, sf_dir: str, with_position: bool = False) -> DataFrame:
    """Raw categorical columns with nulls, negatives and out-of-range ids."""
    k = F.col("item_id") - 1
    whole = F.floor("value")
    event = F.col("event_id")
    many = F.array(k % 70, k % 9 - 3, k % 61, whole % 80, k)
    return impressions(spark, sf_dir, with_position).select(
        "event_id",
        "user_id",
        "item_id",
        "timestamp",
        "label_type",
        *(POSITION if with_position else ()),
        F.when(event % 7 != 0, whole % 50 - 5).alias("user_int_feats_1"),
        k.alias("user_int_feats_2"),
        F.when(event % 11 == 0, None)
        .when(event % 10 == 0, F.array().cast("array<bigint>"))
        .otherwise(many)
        .alias("user_int_feats_3"),
        F.col("item_id").alias("item_int_feats_11"),
    )


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings cut into three lists, with holes, NaN, infinities and short lists."""
    v = F.col("vec_id")
    emb = read_impressions(spark, f"{sf_dir}/embeddings.parquet")
    holed = F.transform(
        "embedding",
        lambda x, i: F.when((v + i) % 17 == 0, None)
        .when((v + i) % 19 == 0, F.lit(float("nan")))
        .when((v + i) % 23 == 0, F.lit(float("inf")))
        .otherwise(x.cast("double")),
    )

    def part(start: int, n: int) -> Column:
        size = F.when(v % 13 == 0, n - 1).otherwise(n)
        return F.when(v % 50 != 0, F.slice(F.col("h"), F.lit(start), size))

    return emb.select("vec_id", "label", holed.alias("h")).select(
        "vec_id",
        "label",
        part(1, 24).alias("user_dense_feats_61"),
        part(25, 16).alias("user_dense_feats_62"),
        part(41, 24).alias("user_dense_feats_130"),
        F.array(F.col("label").cast("double")).alias("item_dense_feats_129"),
    )


def histories(spark: SparkSession, sf_dir: str, with_position: bool = False) -> DataFrame:
    """Each impression with its user's earlier ones as the lists of domain ``seq_a``."""
    return build_histories(
        impressions(spark, sf_dir, with_position),
        {
            "seq_a_38": F.col("item_id"),
            "seq_a_39": F.coalesce(F.col("label_type") + 1, F.lit(0)).cast("long"),
            "seq_a_9": F.col("timestamp"),
        },
        keep=["event_id", "item_id", "timestamp", *(POSITION if with_position else ())],
        max_len=SEQ_A.max_len,
    )


def whole_log(spark: SparkSession, sf_dir: str, with_position: bool = False) -> DataFrame:
    """Every raw column of ``LAYOUT``: ids and history of the event, dense values of its user."""
    events = ids(spark, sf_dir, with_position)
    own = [c for c in events.columns if c != "user_id"]
    log = build_histories(
        events,
        {
            "seq_a_38": F.col("item_id"),
            "seq_a_39": F.coalesce(F.col("label_type") + 1, F.lit(0)).cast("long"),
            "seq_a_9": F.col("timestamp"),
        },
        keep=own,
        max_len=SEQ_A.max_len,
    ).drop("run")
    values = dense(spark, sf_dir).drop("label").withColumnRenamed("vec_id", "user_id")
    return log.join(values, "user_id", "left")


# Rows of a history are found again by these columns; they start with the columns the
# histories are partitioned by.
HISTORY_KEY = ["user_id", "run", "event_id"]


def scored(
    spark: SparkSession, sf_dir: str, with_nan: bool = False, with_position: bool = False
) -> DataFrame:
    """Labels and logits for the metrics."""
    logit = (F.col("value") - 245) / 100
    if with_nan:
        logit = F.when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(logit)
    return impressions(spark, sf_dir, with_position).select(
        "event_id",
        "user_id",
        derive_label(F.col("label_type")).alias("label"),
        logit.alias("logit"),
        *(POSITION if with_position else ()),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings with their label."""
    emb = read_impressions(spark, f"{sf_dir}/embeddings.parquet")
    return emb.select("vec_id", F.col("embedding").alias("vector"), "label")


def schema_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A schema document whose sizes are observed in the tables, as one row of text."""

    def feature(*parts: Column | int) -> Column:
        return F.array(*[(F.lit(p) if isinstance(p, int) else p).cast("long") for p in parts])

    i = ids(spark, sf_dir).agg(
        F.max("user_int_feats_1").alias("v1"),
        F.max(F.array_max("user_int_feats_3")).alias("v3"),
        F.max(F.size("user_int_feats_3")).alias("n3"),
        F.max("item_int_feats_11").alias("v11"),
    )
    d = dense(spark, sf_dir).agg(
        F.struct(
            F.max(F.size("user_dense_feats_61")).alias("n61"),
            F.max(F.size("user_dense_feats_62")).alias("n62"),
            F.max(F.size("user_dense_feats_130")).alias("n130"),
        ).alias("d")
    ).scalar()
    seq = F.create_map(
        F.lit("seq_a"),
        F.struct(
            F.lit("seq_a").alias("prefix"),
            F.lit(9).cast("long").alias("ts_fid"),
            F.array(
                feature(38, F.col("v11") + 1), feature(39, 4), feature(9, 0)
            ).alias("features"),
        ),
    )
    return i.select(
        F.to_json(
            F.struct(
                F.array(
                    feature(1, F.col("v1") + 1, 1),
                    feature(2, 0, 1),
                    feature(3, F.col("v3") + 1, F.col("n3")),
                ).alias("user_int"),
                F.array(feature(11, F.col("v11") + 1, 1)).alias("item_int"),
                F.array(
                    feature(61, d.getField("n61")),
                    feature(62, d.getField("n62")),
                    feature(130, d.getField("n130")),
                ).alias("user_dense"),
                F.array(feature(129, 1)).alias("item_dense"),
                seq.alias("seq"),
            )
        ).alias("value")
    )
