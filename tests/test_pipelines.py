import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dense
from tidemark.operators.item_history import item_history
from tidemark.plans import derived_inputs as inputs
from tidemark.plans.examples import build_examples
from tidemark.plans.item2vec import fit_item2vec
from tidemark.plans.lifecycle import predict, train
from tidemark.plans.training import fit_classifier, score
from tidemark.schema import FeatureLayout, SequenceDomain, load_feature_schema
from tidemark.sources import bundle, sinks

SF = "/root/testdata/sf0.001"


def test_bundle_round_trip(spark, tmp_path):
    document = {
        "user_int": [[1, 40, 1]], "item_int": [], "user_dense": [[61, 2]], "seq": {},
    }
    rows = spark.createDataFrame([([1.0, 2.0], [1.0, 1.0]), ([3.0, 2.0], [1.0, 0.0])], "v array<double>, p array<double>")
    stats = dense.dense_stats(rows, "v", "p", log1p=False, excluded=())
    path = str(tmp_path / "bundle")
    groups = {"user_ns_groups": {"U1": [1]}, "item_ns_groups": {}}
    bundle.save_bundle(spark, path, json.dumps(document, indent=1), stats, groups)
    b = bundle.load_bundle(spark, path)
    assert [(f.group, f.fid) for f in b.layout.features] == [("user_dense", 61), ("user_int", 1)]
    assert b.groups == groups and b.vocab is None
    assert b.stats.orderBy("pos").collect() == stats.orderBy("pos").collect()
    with pytest.raises(ValueError, match="expected 3 dimensions"):
        bundle.load_dense_stats(spark, f"{path}/dense_stats", 3)


def test_bundle_keeps_the_layout_of_training(spark, tmp_path):
    document = {"user_int": [[1, 40, 1]], "user_dense": [[130, 64]], "seq": {"seq_a": {"prefix": "a", "ts_fid": 9, "features": [[38, 101], [9, 0]]}}}
    (tmp_path / "schema.json").write_text(json.dumps(document))
    layout = load_feature_schema(spark, str(tmp_path / "schema.json"), {130: 30}, {"seq_a": 128}).with_item_history()
    bundle.save_bundle(spark, str(tmp_path / "b"), json.dumps(document), layout=layout)
    assert bundle.load_bundle(spark, str(tmp_path / "b")).layout == layout


def test_bundle_falls_back_to_the_schema_of_the_data(spark, tmp_path):
    (tmp_path / "schema.json").write_text('{"user_int": [[1, 4, 1]]}')
    b = bundle.load_bundle(spark, str(tmp_path / "none"), str(tmp_path / "schema.json"))
    assert b.layout.total_dim("user_int") == 1 and b.stats is None
    with pytest.raises(FileNotFoundError):
        bundle.load_bundle(spark, str(tmp_path / "none"))


def test_later_prediction_wins(spark, tmp_path):
    rows = [("u", 0.9, "a", 5), ("u", 0.1, "b", 0), ("v", 0.4, "a", 1), ("v", 0.3, "a", 0)]
    df = spark.createDataFrame(rows, "user_id string, prob double, src_file string, src_row bigint")
    sinks.write_predictions(df, str(tmp_path / "out"))
    got = {r.user_id: r.prob for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert got == {"u": 0.1, "v": 0.4}


def test_write_examples_by_split(spark, tmp_path):
    df = spark.range(1000).withColumn("split", F.when(F.col("id") < 900, "train").otherwise("valid"))
    sinks.write_examples(df, str(tmp_path / "ex"), shards=5)
    assert len(list((tmp_path / "ex" / "split=train").glob("*.parquet"))) == 5
    sizes = spark.read.parquet(str(tmp_path / "ex")).groupBy(F.input_file_name(), "split").count()
    train = [r["count"] for r in sizes.collect() if r["split"] == "train"]
    assert max(train) - min(train) <= 30
    assert spark.read.parquet(str(tmp_path / "ex")).count() == 1000


def test_build_examples(spark):
    domain = SequenceDomain("seq_a", "a", 9, ((38, 100), (39, 4)), 3)
    layout = FeatureLayout((), (domain,)).with_features("user_int", [(1, 1, 40)]).with_features(
        "user_dense", [(61, 2, 0)]
    )
    now = 1_735_700_400  # 2025-01-01 11:00 at +8
    df = spark.createDataFrame(
        [("u", 5, now, 2, 41, [0.5], [200, 7, 0, 3], [1, 2], [now - 5, now - 6, 0, 1])],
        "user_id string, item_id bigint, timestamp bigint, label_type int, user_int_feats_1 bigint,"
        " user_dense_feats_61 array<float>, a_38 array<bigint>, a_39 array<bigint>, a_9 array<bigint>",
    )
    history = item_history(df.select("item_id", "timestamp"))
    row = build_examples(df, layout, history).first()
    assert row.label == 1
    assert row.user_int_feats == [0, 12, 3, 3] and row.item_int_feats == [12, 3, 3]
    assert row.user_dense_feats[:2] == [0.5, 0.0] and len(row.user_dense_feats) == 6
    assert row.item_dense_feats[0] == pytest.approx(math.log(2)) and len(row.item_dense_feats) == 12
    assert (row.seq_a.a_38, row.seq_a.a_39, row.seq_a_len) == ([0, 7, 0], [1, 2, 0], 3)
    assert row.seq_a_time_bucket == [1, 2, 0]
    assert [tuple(x) for x in row.seq_a_time_feats] == [(11, 3, 2), (11, 3, 2), (0, 0, 0)]
    assert [tuple(x) for x in row.seq_a_day_type_feats] == [(1, 2), (1, 2), (0, 0)]
    assert build_examples(df.drop("label_type"), layout, training=False).first().label == 0


def test_item2vec_is_repeatable(spark):
    df = inputs.histories(spark, SF, with_position=True)

    def fit():
        out = fit_item2vec(df, "seq_a_38", dim=4, top_k=20, max_len=8)
        return {r.raw_id: (r.compact_id, r.vector) for r in out.collect()}

    a = fit()
    assert a == fit() and len(a) == 21
    assert a[0] == (0, [0.0] * 4)
    ranked = sorted(k for k in a if k)
    assert [a[k][0] for k in ranked] == list(range(1, 21))
    rare = fit_item2vec(df, "seq_a_38", dim=4, min_count=10**6, max_len=8).collect()
    assert [tuple(r) for r in rare] == [(0, 0, [0.0] * 4)]


def test_item2vec_factors_rebuild_the_pmi(spark):
    """Two groups of ids that only meet inside: factors are close within, and products near the pmi."""
    rng = random.Random(1)
    rows = [([rng.randrange(lo, lo + 5) for _ in range(8)],) for _ in range(100) for lo in (1, 11)]
    df = spark.createDataFrame(rows, "xs array<long>")
    out = {r.raw_id: r.vector for r in fit_item2vec(df, "xs", dim=6, window=8, iterations=15).collect()}
    assert set(out) == {0, *range(1, 6), *range(11, 16)}

    def cosine(a, b):
        dot = lambda x, y: sum(p * q for p, q in zip(x, y))
        return dot(out[a], out[b]) / math.sqrt(dot(out[a], out[a]) * dot(out[b], out[b]))

    within = [cosine(a, b) for lo in (1, 11) for a in range(lo, lo + 5) for b in range(a + 1, lo + 5)]
    across = [cosine(a, b) for a in range(1, 6) for b in range(11, 16)]
    assert sum(within) / len(within) > 0.6 > 0.3 > sum(map(abs, across)) / len(across)


@pytest.mark.parametrize("kind", ["logistic", "gbt"])
def test_classifier_learns(spark, kind):
    df = spark.range(400).select(
        "id", F.array((F.col("id") % 10).cast("double"), F.lit(1.0)).alias("f"),
        (F.col("id") % 10 > 6).cast("int").alias("y"),
    )
    model = fit_classifier(df, "f", "y", kind, maxIter=5)
    out = score(df, model, "f").groupBy("y").agg(F.avg("prob").alias("p")).orderBy("y").collect()
    assert out[0].p < 0.3 < 0.6 < out[1].p
    with pytest.raises(ValueError):
        fit_classifier(df, "f", "y", "svm")


def test_train_then_predict_with_the_bundle(spark, tmp_path):
    layout = FeatureLayout(()).with_features("user_dense", [(61, 2, 0)])
    log = spark.range(600).select(
        F.concat(F.lit("u"), F.col("id") % 50).alias("user_id"),
        (F.col("id") % 7).alias("item_id"),
        (F.lit(1_700_000_000) + F.col("id") * 60).alias("timestamp"),
        F.when(F.col("id") % 4 == 0, 2).alias("label_type"),
        F.array((F.col("id") % 4).cast("float"), F.lit(None).cast("float")).alias("user_dense_feats_61"),
        F.lit("f").alias("src_file"),
        F.col("id").alias("src_row"),
    )
    # The classes are separable; without a penalty the weights would grow without bound and
    # amplify the different item traffic of the shorter validation part.
    model, result = train(log, layout, 0.25, maxIter=20, regParam=0.05)
    row = result.first()
    assert row.auc > 0.95 and row.logloss < 0.4
    path = str(tmp_path / "bundle")
    bundle.save_bundle(spark, path, '{"user_dense": [[61, 2]]}', model=model)
    loaded = bundle.load_bundle(spark, path)
    assert loaded.layout == layout
    scored = predict(log.drop("label_type"), loaded)
    assert scored.count() == 600
    low = scored.where("src_row % 4 = 3").agg(F.max("prob")).first()[0]
    high = scored.where("src_row % 4 = 0").agg(F.min("prob")).first()[0]
    assert low < 0.5 < high
    assert sinks.latest_predictions(scored).count() == 50
