"""Sparse design rows, and training whose transform is saved and repeated."""

import math

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import design, storage
from tidemark.plans import lifecycle
from tidemark.schema import FeatureLayout, SequenceDomain
from tidemark.sources import bundle


def entries(spark, ids, offset, denominator):
    df = spark.createDataFrame([(k, x) for k, x in enumerate(ids)], "k int, ids array<long>")
    out = df.select("k", design.counted_ids(F.col("ids"), offset, F.lit(denominator)).alias("e")).orderBy("k")
    return [[(e["i"], e["v"]) for e in r["e"]] for r in out.collect()]


def test_counted_ids(spark):
    lists = [[], [0, 0], [3], [5, 3, 5, 0, 3, 5], list(range(50, 0, -1)), [7] * 300, [-4, 2, 0, 2]]
    want = [sorted((10 + x, ids.count(x) / 4) for x in set(ids) if x > 0) for ids in lists]
    assert entries(spark, lists, 10, 4) == want


def test_vectors_keep_every_digit(spark):
    values = [0.1, 1 / 3, -1e-300, 1.7976931348623157e308, 5e-324, 123456789.123456789]
    df = spark.createDataFrame([(values,), ([],)], "v array<double>")
    e = F.transform("v", lambda x, i: F.struct((i * 2 + 1).cast("int").alias("i"), x.alias("v")))
    out = df.select(e.alias("_entries")).select(design.entries_to_vector(F.col("_entries"), 20).alias("x"), vector_to_array("x"))
    for row, want in zip(out.collect(), (values, []), strict=True):
        assert row["x"].size == 20 and list(row["x"].values) == want
        assert list(row["x"].indices) == [2 * i + 1 for i in range(len(want))]


LAYOUT = (
    FeatureLayout((), (SequenceDomain("seq_a", "seq_a", 9, ((38, 30), (39, 9)), 6),))
    .with_features("user_int", [(1, 1, 12), (2, 1, 0), (3, 3, 50)])
    .with_features("user_dense", [(62, 2, 0), (130, 1, 0)])
)


def log_of(spark, n=400):
    at = F.lit(1_700_000_000) + F.col("id") * 60
    past = F.transform(F.sequence(F.lit(1), F.col("id") % 9), lambda k: (F.col("id") * k) % 31)
    return spark.range(n).select(
        "id",
        F.concat(F.lit("u"), F.col("id") % 50).alias("user_id"),
        (F.col("id") % 7).alias("item_id"),
        at.alias("timestamp"),
        F.when((F.col("id") % 4 == 0) != (F.col("id") % 11 == 0), 2).alias("label_type"),
        F.when(F.col("id") % 13 != 0, F.col("id") % 14).alias("user_int_feats_1"),
        F.col("id").alias("user_int_feats_2"),
        F.when(F.col("id") % 5 != 0, F.array(F.col("id") % 52, F.lit(3).cast("long"), F.lit(None).cast("long"), F.lit(8).cast("long")))
        .alias("user_int_feats_3"),
        F.array((F.col("id") % 6).cast("float"), F.lit(float("nan")).cast("float")).alias("user_dense_feats_62"),
        F.when(F.col("id") % 3 == 0, F.array((F.col("id") % 8).cast("float"))).alias("user_dense_feats_130"),
        F.when(F.col("id") % 9 > 0, past).alias("seq_a_38"),
        F.when(F.col("id") % 9 > 0, F.transform(past, lambda x: x % 11)).alias("seq_a_39"),
        F.when(F.col("id") % 9 > 0, F.transform(past, lambda x: at - x)).alias("seq_a_9"),
        F.lit("f").alias("src_file"),
        F.col("id").alias("src_row"),
    )


def brute_row(r, hash_buckets, threshold):
    """Index to value of the int and sequence blocks."""
    found, offset = {}, 0

    def put(ids, vocab, denominator=None):
        nonlocal offset
        route = 0 if vocab <= 0 else hash_buckets if vocab > threshold else vocab
        if not route:
            return
        clean = [x if x is not None and 0 < x < vocab else 0 for x in ids]
        share = denominator or max(1, sum(x > 0 for x in clean))
        for x in clean:
            if x:
                at = offset + (x % hash_buckets + 1 if route == hash_buckets else x)
                found[at] = found.get(at, 0) + 1 / share
        offset += route + 1

    put([r["user_int_feats_1"]], 12)
    put([r["user_int_feats_2"]], 0)
    put((r["user_int_feats_3"] or [])[:3], 50)
    for name, vocab in (("seq_a_38", 30), ("seq_a_39", 9)):
        ids = (r[name] or [])[:6]
        put(ids, vocab, max(1, len(ids)))
    return found


@pytest.mark.parametrize(("threshold", "buckets"), [(1000, 5), (20, 5), (1, 3)])
def test_design_rows_agree_with_brute_force(spark, threshold, buckets):
    how = bundle.Transform(calendar=False, history=False, scaling="none", hash_threshold=threshold, hash_buckets=buckets)
    log = log_of(spark)
    blocks = design.plan_design(spark, LAYOUT, threshold, buckets)
    dense_from = blocks[-1].offset
    rows = {r["id"]: r for r in log.collect()}
    for r in lifecycle.design_rows(log, LAYOUT, how, keep=("id",)).collect():
        got = {int(i): v for i, v in zip(r["features"].indices, r["features"].values, strict=True)}
        want = brute_row(rows[r["id"]], buckets, threshold)
        assert {i: v for i, v in got.items() if i < dense_from} == pytest.approx(want)
        assert got.get(dense_from, 0) == r["id"] % 6


def test_stored_examples_are_not_padded(spark):
    how = bundle.Transform(calendar=False, history=False, scaling="none")
    raw = storage.packed(lifecycle._raw_examples(log_of(spark), LAYOUT, how, ("id",), True))
    assert raw.count() == 400
    for r in raw.collect():
        assert r["seq_a_len"] == min(6, r["id"] % 9)
        assert len(r["seq_a"]["seq_a_38"]) == len(r["seq_a"]["seq_a_39"]) == r["seq_a_len"]
    assert not {"seq_a_time_bucket", "seq_a_time_feats"} & set(raw.columns)


def test_saved_transform_repeats_training(spark, tmp_path):
    log = log_of(spark)
    how = bundle.Transform(
        tz_hours=3.0, excluded=((1, 2),), hash_threshold=20, hash_buckets=7, word2vec=(("seq_a", 38), ("user_int", 3)), vector_dim=3, key=("id",)
    )
    trained = lifecycle.fit_design(log, LAYOUT, how, maxIter=30, regParam=0.1)
    trained.save(str(tmp_path), '{"user_int": [[1, 12, 1]]}', {"user_ns_groups": {"U1": [1]}})
    loaded = bundle.load_bundle(spark, str(tmp_path))
    assert loaded.transform == how and loaded.layout == LAYOUT
    first = {r["src_row"]: r["prob"] for r in trained.score(log, ("src_row",)).collect()}
    # Scoring has no label column; the rows come in other partitions.
    again = lifecycle.predict(log.drop("label_type").repartition(3), loaded).collect()
    assert {r["src_row"]: r["prob"] for r in again} == pytest.approx(first, abs=1e-12)
    # Scaling by the statistics of training, whatever the rows to be scored are.
    one = lifecycle.predict(log.where("id % 4 = 1 and id < 300").drop("label_type"), loaded).collect()
    assert len(one) == 75
    with pytest.raises(ValueError):
        lifecycle.design_rows(log, LAYOUT, bundle.Transform()).count()
    with pytest.raises(ValueError):
        lifecycle.design_rows(log, LAYOUT, bundle.Transform(scaling="none", word2vec=(("seq_a", 38),)))


def test_branches_scale_the_values(spark):
    branches = (("counts", (62,), "log1p_nonneg"), ("score", (130, 131), "signed_log1p"))
    how = bundle.Transform(scaling="branches", user_branches=branches, calendar=False, history=False)
    from_ = design.plan_design(spark, LAYOUT)[-1].offset
    rows = lifecycle.design_rows(log_of(spark), LAYOUT, how, keep=("id",)).select("id", vector_to_array("features").alias("x"))
    for r in rows.collect():
        counts, _, score = r["x"][from_:]
        assert counts == pytest.approx(math.log1p(r["id"] % 6))
        assert score == pytest.approx(math.log1p(r["id"] % 8) if r["id"] % 3 == 0 else 0.0)


def test_no_executor_runs_python(spark):
    rows = lifecycle.design_rows(log_of(spark), LAYOUT, bundle.Transform(scaling="none"), keep=("id",))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_designs_are_stored_as_vectors(spark):
    how = bundle.Transform(calendar=False, history=False, scaling="none", hash_threshold=20, hash_buckets=5)
    rows = lifecycle.design_rows(log_of(spark), LAYOUT, how, keep=("id",))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and "transform(" not in plan  # nothing of the design is made again by a reader
    assert rows.schema["features"].dataType.typeName() == "vectorudt"


def test_stored_vectors_are_those_of_the_columns(spark):
    layout = FeatureLayout(()).with_features("user_dense", [(1, 3, 0), (2, 140, 0)])
    blocks = design.plan_design(spark, layout)
    values = F.transform(F.sequence(F.lit(0), F.lit(142)), lambda i: F.when((i + F.col("id")) % 3 > 0, 1 / (i + F.col("id"))).otherwise(0.0))
    df = spark.range(5).withColumn("user_dense_feats", values)
    lazy = design.design_vectors(df, layout, blocks, 8, ["id"]).orderBy("id").collect()
    assert design.stored_design(df, layout, blocks, 8, ["id"]).orderBy("id").collect() == lazy
    for r in lazy:
        want = {i: 1 / (i + r["id"]) for i in range(143) if (i + r["id"]) % 3}
        assert dict(zip(r["features"].indices.tolist(), r["features"].values.tolist(), strict=True)) == want


def test_short_dense_blocks_are_as_long_ones(spark):
    rows = [([0.0, 2.5, -1.0],), ([0.0, 0.0, 0.0],), (None,), ([float("nan"), 1e-300, -0.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    short, long = (design._dense_entries(F.col("v"), 7, n).alias(f"n{n}") for n in (3, 200))
    for r in df.select(short, long).collect():
        assert repr(r["n3"]) == repr(r["n200"] or [])


def test_pooled_means_with_and_without_a_join(spark):
    """A repeated key takes the way of the join; a null key has no row on either way."""
    how = bundle.Transform(
        calendar=False, history=False, scaling="none", hash_threshold=60, hash_buckets=7,
        word2vec=(("seq_a", 38), ("user_int", 3)), vector_dim=3, key=("id",),
    )
    vectors = spark.createDataFrame(
        [(f, k, [k / 3, -k / 7, 1.0]) for f in ("seq_a_38", "user_int_3") for k in range(1, 52) if k % 4], "feature string, raw_id long, vector array<double>"
    )
    log = log_of(spark).withColumn("id", F.when(F.col("id") != 11, F.col("id")))
    offsets = {b.group: b.offset for b in design.plan_design(spark, LAYOUT, 60, 7, how.word2vec, 3)  if b.route == "word2vec"}
    found = []
    for more in (0, 1):
        doubled = log.unionByName(log.where("id = 20")) if more else log
        rows = lifecycle.design_rows(doubled, LAYOUT, how, vectors=vectors, keep=("id",)).select("id", vector_to_array("features").alias("x")).collect()
        assert len(rows) == 399 + more and all(r["id"] is not None for r in rows)
        found.append({r["id"]: r["x"] for r in rows if r["id"] != 20})
    assert found[0].keys() == found[1].keys()
    for id_, x in found[0].items():
        assert x == pytest.approx(found[1][id_])
    for r in log.where("id is not null and id != 20").collect():
        ids = [k if 0 < k < 30 else 0 for k in (r["seq_a_38"] or [])[:6]]
        want = [sum(f(k) for k in ids if k % 4) / max(1, len(ids)) for f in (lambda k: k / 3, lambda k: -k / 7, lambda k: 1.0)]
        assert found[0][r["id"]][offsets["seq_a"] : offsets["seq_a"] + 3] == pytest.approx(want)
