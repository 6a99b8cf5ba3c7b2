"""Aggregates, lookups, ranks and splits against brute force, with skewed keys."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.fixed_values import ITEM_HISTORY_NAMES
from tidemark.functions.arrays import pad_float_list_with_presence
from tidemark.operators import chunks, dense, filters, item_history, lookups, pooling, ranking, splits, vocab
from tidemark.plans import histories, item2vec
from tidemark.plans.histories import build_histories
from tidemark.schema import FeatureLayout, SequenceDomain
from tidemark.sources.impressions import read_impressions, union_files


def entropy(counts):
    total = sum(counts)
    return -sum(c / total * math.log(c / total) for c in counts)


def history_rows(log):
    newest, out = max(t for _, t in log), {}
    by_item = defaultdict(list)
    for i, t in log:
        by_item[i].append(t)
    for i, ts in by_item.items():
        hours, days = Counter(t // 3600 for t in ts), Counter(t // 86400 for t in ts)
        first, last = min(ts) or newest, max(ts) or newest
        last_n = [
            sum(c for h, c in hours.items() if h >= newest // 3600 - w + 1) for w in (1, 6, 24)
        ]
        out[i] = [
            math.log1p(len(ts)), math.log1p(len(hours)), len(days), max(hours.values()) / len(ts),
            math.log1p(max(0, last - first) / 3600), math.log1p(max(0, newest - last) / 3600),
            *[math.log1p(n) for n in last_n],
            last_n[0] / last_n[2] if last_n[2] else 0.0,
            entropy(hours.values()), entropy(days.values()),
        ]
    return out


def test_item_history_brute_force(spark):
    rnd = random.Random(1)
    # Item 1 holds half of the log; item 7 has one row, item 8 a single busy hour, item 9 time 0.
    log = [(1 if rnd.random() < 0.5 else rnd.randrange(2, 6), rnd.randrange(10**5, 10**6))
           for _ in range(800)]
    log += [(7, 500_000)] + [(8, 720_000 + s) for s in range(30)] + [(9, 0), (9, 900_000), (10, 0)]
    df = spark.createDataFrame(log, "item_id bigint, timestamp bigint")
    got = {r.item_id: [r[n] for n in ITEM_HISTORY_NAMES] for r in item_history.item_history(df).collect()}
    want = history_rows(log)
    assert got.keys() == want.keys()
    for item in want:
        assert got[item] == pytest.approx(want[item], abs=1e-9), item
    assert got[8][3] == 1.0 and got[8][10] == 0.0


def test_item_history_of_many_groups(spark, monkeypatch):
    rnd = random.Random(3)
    log = [(rnd.randrange(40), rnd.randrange(10**6)) for _ in range(900)]
    df = spark.createDataFrame(log, "item_id bigint, timestamp bigint")
    monkeypatch.setattr(item_history, "GROUPS_PER_TASK", 30)
    hours = item_history._hour_rows(df, 900)
    assert hours.rdd.getNumPartitions() == 30  # the session has 8
    got = {r.item_id: [r[n] for n in ITEM_HISTORY_NAMES] for r in item_history.item_history(df).collect()}
    want = history_rows(log)
    assert got.keys() == want.keys()
    for item in want:
        assert got[item] == pytest.approx(want[item], abs=1e-9), item


def test_item_history_range_and_empty(spark):
    log = [(1, 10), (1, 20), (2, 30), (2, 40)]
    df = spark.createDataFrame(log, "item_id bigint, timestamp bigint")
    got = item_history.item_history(df, (10, 30)).collect()
    want = history_rows([(1, 20), (2, 30)])
    assert {r.item_id: [r[n] for n in ITEM_HISTORY_NAMES] for r in got} == {
        k: pytest.approx(v) for k, v in want.items()
    }
    assert item_history.item_history(df, (100, None)).count() == 0


def test_left_lookup_keeps_nulls_of_the_table(spark):
    table = spark.createDataFrame([(1, None), (2, 2.0)], "k long, v double")
    df = spark.createDataFrame([(1,)] * 20 + [(2,), (3,), (None,)], "k long")
    for share in (0.1, 1.0):
        out = lookups.left_lookup(df, table, "k", {"v": F.lit(-1.0)}, share=share).distinct().collect()
        assert {(r["k"], r["v"]) for r in out} == {(1, None), (2, 2.0), (3, -1.0), (None, -1.0)}


@pytest.mark.parametrize("most_bytes", [1 << 20, 0], ids=["sent", "shuffled"])
def test_pooling_and_compact_ids_by_either_lookup(spark, most_bytes):
    rows = [(1, [5, 5, 9, 0, 7], [1, 3, 1, 2, 1], 4), (2, None, None, 3), (3, [], [], 0), (4, [5, None, 5], [2, 2, None], 9), (5, [8], [1], 0)]
    df = spark.createDataFrame(rows, "k int, ids array<long>, b array<int>, n int")
    vectors = spark.createDataFrame([(5, [1.0, 2.0]), (7, [10.0, 0.0])], "raw_id long, vector array<double>")

    def got(out):
        return {r["k"]: [round(x, 9) for x in r["pooled"]] for r in out.collect()}

    mean = got(pooling.sequence_mean_pool(df, ["k"], "ids", "n", vectors, 2, most_bytes))
    assert mean == {1: [0.5, 1.0], 2: [0, 0], 3: [0, 0], 4: [round(2 / 3, 9), round(4 / 3, 9)], 5: [0, 0]}
    mean = got(pooling.embed_mean_pool(df, ["k"], "ids", vectors, 2, most_bytes))
    assert mean == {1: [3.0, 1.0], 2: [0, 0], 3: [0, 0], 4: [1.0, 2.0], 5: [0, 0]}
    w = [math.exp(-0.5 * (b - 1)) for b in (1, 3, 1, 2)]
    decayed = got(pooling.time_decay_pool(df, ["k"], "ids", "b", "n", vectors, 2, 0.5, most_bytes))
    share = round((w[0] + w[1]) / sum(w), 9)
    assert decayed == {1: [share, round(2 * share, 9)], 2: [0, 0], 3: [0, 0], 4: [0.5, 1.0], 5: [0, 0]}

    known = [("x", 5, 1), ("x", 9, 2), ("y", 1, 7)]
    known = spark.createDataFrame(known, "feature string, raw_id long, compact_id long")
    out = vocab.compact_ids_many(df, ["k"], {"ids": "x", "b": "y"}, known, most_bytes)
    assert {r["k"]: (r["ids"], r["b"]) for r in out.collect()} == {
        1: ([1, 1, 2, 0, 0], [7, 0, 7, 0, 7]), 2: ([], []), 3: ([], []), 4: ([1, 0, 1], [0, 0, 0]), 5: ([0], [7])
    }


def test_a_small_table_is_looked_up_in_one_scan(spark, tmp_path):
    spark.range(1000).select((F.col("id") % 10).alias("k"), "id").write.parquet(f"{tmp_path}/rows")
    df = spark.read.parquet(f"{tmp_path}/rows")
    table = spark.createDataFrame([(1, 2.0)], "k long, v double")
    out = lookups.counted_lookup(df, table, "k", {"v": F.lit(0.0)}, 50)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange hashpartitioning" not in plan
    assert out.agg(F.sum("v")).first()[0] == 200.0


def test_left_lookup_with_hot_keys(spark):
    # Key 1 holds a third of the rows, key 2 (absent from the table) another third.
    keys = [1] * 400 + [2] * 400 + [None] * 50 + list(range(3, 353))
    df = spark.createDataFrame(list(enumerate(keys)), "row int, k bigint")
    table = spark.createDataFrame([(1, 10.0), (5, 50.0), (999, 1.0)], "k bigint, v double")
    out = lookups.left_lookup(df, table, "k", {"v": F.lit(-1.0)}, share=0.1)
    got = {r["row"]: (r["k"], r["v"]) for r in out.collect()}
    known = {1: 10.0, 5: 50.0}
    assert got == {i: (k, known.get(k, -1.0)) for i, k in enumerate(keys)}


def test_hot_rows_are_spread(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"))
        table = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        out = lookups.left_lookup(df, table, "k", {"v": F.lit(-1)}, share=0.1)
        hot = out.where("k = 1").groupBy(F.spark_partition_id().alias("p")).agg(
            F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")
        ).collect()
        assert len(hot) == 8 and max(r.n for r in hot) < 2 * min(r.n for r in hot)
        assert {(r.lo, r.hi) for r in hot} == {(2, 2)}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_lookup_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(lookups, "ROWS_PER_TASK", 50, raising=False)
    rows = [(i, None if i % 9 == 0 else 1 if i % 2 else i % 40) for i in range(600)]
    df = spark.createDataFrame(rows, "r long, k long")
    table = spark.createDataFrame([(k, k * 10) for k in range(1, 30)], "k long, v long")
    out = lookups.left_lookup(df, table, "k", {"v": F.lit(-1).cast("long")})
    assert out.rdd.getNumPartitions() == 12  # the session has 8
    assert {r.r: r.v for r in out.collect()} == {r: k * 10 if k and k < 30 else -1 for r, k in rows}


def test_heavy_keys_are_few(spark):
    df = spark.createDataFrame([(1,)] * 50 + [(2,)] * 30 + [(i,) for i in range(3, 23)], "k int")
    assert {r.k for r in lookups.heavy_keys(df, "k", 0.25).collect()} == {1, 2}


@pytest.mark.parametrize("shifts", [ranking.ID_SHIFTS, ranking.SECOND_SHIFTS])
def test_value_at_rank(spark, shifts):
    rnd = random.Random(5)
    values = [rnd.choice([-(2**60), -7, 0, 3, 3, 2**21, 2**21 + 1, 2**43, 2**62]) for _ in range(90)]
    values += [rnd.randrange(2**50) for _ in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    ordered = sorted(values)
    for rank in (0, 1, 44, 90, 149):
        got = ranking.value_at_rank(df, "v", F.lit(rank), shifts).collect()
        assert [r.value for r in got] == [ordered[rank]]
    assert ranking.value_at_rank(df, "v", F.lit(150), shifts).count() == 0


def test_top_k_vocab_ties(spark):
    freq = spark.createDataFrame(
        [(40, 9), (10, 5), (2**45, 5), (30, 5), (20, 5), (50, 1)], "token bigint, cnt bigint"
    )

    def ids(k):
        return [tuple(r)[:2] for r in vocab.top_k_vocab(freq, k).orderBy("compact_id").collect()]

    assert ids(3) == [(10, 1), (20, 2), (40, 3)]
    assert ids(5) == [(10, 1), (20, 2), (30, 3), (40, 4), (2**45, 5)]
    assert len(ids(6)) == len(ids(99)) == 6


@pytest.fixture
def files(spark, tmp_path):
    """Three files of 25, 10 and 15 rows; ``n`` counts rows in scan order."""
    start = 0
    for name, size in (("a", 25), ("b", 10), ("c", 15)):
        spark.range(start, start + size).select(
            F.col("id").alias("n"), F.array(F.col("id") % 3, F.col("id")).alias("seq")
        ).coalesce(1).write.parquet(str(tmp_path / f"raw-{name}"))
        part = next((tmp_path / f"raw-{name}").glob("*.parquet"))
        (tmp_path / "log").mkdir(exist_ok=True)
        (tmp_path / "log" / f"{name}.parquet").write_bytes(part.read_bytes())
        start += size
    return str(tmp_path / "log")


def test_read_impressions(spark, files, tmp_path):
    assert read_impressions(spark, files).count() == 50
    assert read_impressions(spark, f"{files}/b.parquet").count() == 10
    (tmp_path / "empty").mkdir()
    for missing in (str(tmp_path / "empty"), str(tmp_path / "nowhere")):
        with pytest.raises(FileNotFoundError):
            read_impressions(spark, missing)
    assert union_files(spark, [f"{files}/a.parquet", f"{files}/c.parquet"]).count() == 40


@pytest.mark.parametrize("n", [1, 24, 25, 26, 40, 49, 50, 51])
def test_limit_sentences_over_files(spark, files, n):
    df = read_impressions(spark, files, with_position=True)
    s = vocab.limit_sentences(df.where("n <> 3"), n)
    assert sorted(r.n for r in s.collect()) == [i for i in range(50) if i != 3][:n]


@pytest.mark.parametrize(
    "valid,train,compat", [(0.25, 1.0, False), (0.01, 1.0, False), (0.0, 1.0, False),
                           (0.3, 0.5, False), (0.3, 0.5, True), (0.0, 0.4, True)],
)
def test_split_by_position(spark, files, valid, train, compat):
    df = read_impressions(spark, files, with_position=True)
    out = splits.split_by_position(df, valid, train, chunk_rows=10, reference_compat=compat)
    # Chunks of a: 10, 10, 5 rows; of b: 10; of c: 10, 5.
    chunk = [0] * 10 + [1] * 10 + [2] * 5 + [3] * 10 + [4] * 10 + [5] * 5
    n_valid = 0 if valid <= 0 else max(1, int(6 * valid))
    start = 6 - n_valid
    end = max(1, int(start * train)) if train < 1 else start
    want = {}
    for n, c in enumerate(chunk):
        if c < end:
            want[n] = "train"
        elif compat or c >= start:
            want[n] = "valid"
    assert {r.n: r.split for r in out.collect()} == want


def test_time_cutoff_is_numpy_percentile(spark):
    rnd = random.Random(11)
    for size, ratio in ((1, 0.1), (2, 0.5), (17, 0.1), (101, 0.25), (300, 0.37)):
        ts = [rnd.choice([1_700_000_000, rnd.randrange(1_600_000_000, 1_800_000_000)])
              for _ in range(size)]
        df = spark.createDataFrame([(t,) for t in ts], "timestamp bigint")
        want = int(np.percentile(ts, (1.0 - ratio) * 100))
        assert splits.time_cutoff(df, ratio).first().cutoff == want


def test_split_by_time_keeps_ties_in_training(spark):
    df = spark.createDataFrame([(5,)] * 9 + [(6,)], "timestamp bigint")
    out = splits.split_by_time(df, 0.2).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in out} == {"train": 9, "valid": 1}


def test_time_cutoff_of_a_sketch(spark):
    df = spark.range(50_000).select((F.col("id") * F.col("id") % 49_999).alias("timestamp"))
    ts = sorted(r.timestamp for r in df.collect())
    cut = splits.time_cutoff(df, 0.2, sketch=True).first().cutoff
    assert abs(sum(t <= cut for t in ts) / len(ts) - 0.8) < 0.02
    parts = {r.split: r["count"] for r in splits.split_by_time(df, 0.2, sketch=True).groupBy("split").count().collect()}
    assert sum(parts.values()) == 50_000 and abs(parts["valid"] - 10_000) < 1_000


@pytest.mark.parametrize("shards", [1, 2, 3, 7])
def test_balanced_shards(spark, files, shards):
    df = read_impressions(spark, files, with_position=True)
    # Chunks of a: 10, 10, 5 rows; of b: 10; of c: 10, 5.
    rows = [10, 10, 5, 10, 10, 5]
    loads, want = [0] * shards, {}
    for k in sorted(range(6), key=lambda k: -rows[k]):
        want[k] = min(range(shards), key=lambda s: loads[s])
        loads[want[k]] += rows[k]
    chunk = [0] * 10 + [1] * 10 + [2] * 5 + [3] * 10 + [4] * 10 + [5] * 5
    out = chunks.with_shards(df, shards, chunk_rows=10)
    assert {r.n: r.shard for r in out.collect()} == {n: want[c] for n, c in enumerate(chunk)}
    assert chunks.with_shards(df.limit(0), shards).collect() == []


def test_balance_of_many_short_files(spark):
    rnd = random.Random(3)
    sizes = [rnd.randrange(1, 40) for _ in range(60)]
    rows = [(f"f{f:03}", r) for f, n in enumerate(sizes) for r in range(n)]
    df = spark.createDataFrame(rows, "src_file string, src_row long").repartition(5)
    loads = [0] * 4
    parts = [min(16, n - at) for n in sizes for at in range(0, n, 16)]
    for n in sorted(parts, reverse=True):
        loads[min(range(4), key=lambda s: loads[s])] += n
    got = chunks.with_shards(df, 4, 16).groupBy("shard").count().collect()
    assert sorted((r.shard, r["count"]) for r in got) == list(enumerate(loads))


def test_shuffle_keeps_to_its_window(spark, files):
    df = read_impressions(spark, files, with_position=True)

    def batches(seed, pass_no=0):
        out = chunks.shuffle_in_windows(df, 3, seed, window_batches=4, pass_no=pass_no).collect()
        return [r.n for r in sorted(out, key=lambda r: (r.batch, r.place))]

    one = batches(1)
    assert sorted(one) == list(range(50)) and one == batches(1)
    assert len({tuple(one), tuple(batches(2)), tuple(batches(1, 1))}) == 3
    for at, n in enumerate(one):
        assert at // 12 == n // 12
    assert chunks.shuffle_in_windows(df.limit(0), 3, 1).collect() == []


def test_shuffle_is_seeded_and_whole(spark):
    df = spark.range(500)

    def order(seed, n=0):
        return [r.id for r in splits.shuffle_examples(df, ["id"], seed, 4, n).collect()]

    assert order(1) == order(1) != order(2)
    assert order(1) != order(1, 1)
    assert sorted(order(1)) == list(range(500))


def test_oob_and_assert(spark):
    layout = FeatureLayout(
        (), (SequenceDomain("s", "s", None, ((1, 3),), 2),)
    ).with_features("user_int", [(1, 1, 5), (2, 2, 4), (3, 1, 0)])
    df = spark.createDataFrame(
        [(7, [9, 1, 99], 8, [3, 4, 5]), (None, None, 1, None), (5, [4], -2, [2])],
        "user_int_feats_1 bigint, user_int_feats_2 array<bigint>, user_int_feats_3 bigint,"
        " s_1 array<bigint>",
    )
    got = {tuple(r) for r in filters.oob_report(df, layout).collect()}
    assert got == {
        ("user_int", "user_int_feats_1", 2, 7, 5, 5),
        ("user_int", "user_int_feats_2", 2, 9, 4, 4),
        ("seq_s", "s_1", 2, 4, 3, 3),
    }
    with pytest.raises(ValueError, match="seq_s s_1: 2 values out of range"):
        filters.assert_in_vocab(df, layout)


def test_time_filter_reaches_the_scan(spark, files):
    df = filters.filter_time_range(read_impressions(spark, files), 5, 9, column="n")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(n,5)" in plan and "LessThanOrEqual(n,9)" in plan
    assert [r.n for r in df.orderBy("n").collect()] == [6, 7, 8, 9]


def test_dense_stats_and_scaling(spark):
    rows = [([1.0, None, 5.0, 2.0],), ([3.0, float("nan"), 5.0, 4.0],), ([None, 7.0, 5.0, 0.0],), (None,)]
    v, p = pad_float_list_with_presence(F.col("x"), 4)
    df = spark.createDataFrame(rows, "x array<double>").select(v.alias("v"), p.alias("p"))
    stats = dense.dense_stats(df, "v", "p", log1p=False, excluded=((3, 9),))
    got = [tuple(r) for r in stats.orderBy("pos").collect()]
    # One observed value, a constant and an excluded position all get deviation 1.
    assert got == [(0, 2, 2.0, 1.0), (1, 1, 7.0, 1.0), (2, 3, 5.0, 1.0), (3, 0, 0.0, 1.0)]
    out = dense.zscore_apply(df, "v", "p", stats, log1p=False, excluded=((3, 9),))
    assert [r.v for r in out.collect()] == [
        [-1.0, 0.0, 0.0, 2.0], [1.0, 0.0, 0.0, 4.0], [0.0, 0.0, 0.0, 0.0], [0.0] * 4,
    ]


def test_pooling_and_compact_ids(spark):
    rows = [
        (1, [7, 7, 0, 5], [1, 1, 2, 3], 3),
        (2, [], [], 0),
        (3, None, None, 0),
        (4, [0, 0], [0, 0], 2),
        (5, [6], [70], 1),
    ]
    df = spark.createDataFrame(rows, "r int, ids array<bigint>, b array<int>, n int")
    vectors = spark.createDataFrame(
        [(7, [1.0, 2.0]), (6, [4.0, 0.0]), (8, [9.0, 9.0])], "raw_id bigint, vector array<float>"
    )

    def values(out):
        return {r.r: r[1] for r in out.collect()}

    mean = values(pooling.embed_mean_pool(df, ["r"], "ids", vectors, 2))
    assert mean[1] == pytest.approx([2 / 3, 4 / 3]) and mean[5] == [4.0, 0.0]
    assert mean[2] == mean[3] == mean[4] == [0.0, 0.0]
    seq = values(pooling.sequence_mean_pool(df, ["r"], "ids", "n", vectors, 2))
    assert seq[1] == pytest.approx([2 / 3, 4 / 3]) and seq[3] == [0.0, 0.0]
    decayed = values(pooling.time_decay_pool(df, ["r"], "ids", "b", "n", vectors, 2, 0.5))
    w = math.exp(-0.5)
    assert decayed[1] == pytest.approx([2 / (2 + w), 4 / (2 + w)])
    # A weight below the floor of the denominator no longer cancels.
    assert decayed[5] == pytest.approx([4.0 * math.exp(-0.5 * 69) / 1e-6, 0.0])
    words = spark.createDataFrame([(5, 1), (7, 2), (9, 3)], "raw_id bigint, compact_id bigint")
    ids = values(vocab.compact_ids(df, ["r"], "ids", words))
    assert ids == {1: [2, 2, 0, 1], 2: [], 3: [], 4: [0, 0], 5: [0]}


@pytest.mark.parametrize("max_len", [1, 3, 4, 256])
def test_histories_brute_force(spark, max_len):
    rnd = random.Random(2)
    # User 1 holds most of the events, many of them at the same second.
    events = [
        (i, 1 if rnd.random() < 0.6 else rnd.randrange(2, 6), rnd.randrange(0, 30_000, 500), rnd.randrange(99))
        for i in range(300)
    ]
    df = spark.createDataFrame(events, "event_id bigint, user_id bigint, timestamp bigint, x bigint")
    out = build_histories(
        df, {"xs": F.col("x"), "ts": F.col("timestamp")}, ["event_id", "x"], max_len=max_len
    )
    want = {}
    for user in {e[1] for e in events}:
        own = sorted((e for e in events if e[1] == user), key=lambda e: (e[2], e[0]))
        for i, e in enumerate(own):
            seen = own[max(0, i - max_len):i][::-1]
            want[e[0]] = (user, e[3], [s[3] for s in seen], [s[2] for s in seen])
    assert {r.event_id: (r.user_id, r.x, r.xs, r.ts) for r in out.collect()} == want


def test_tasks_of_histories_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(histories, "EVENTS_PER_TASK", 10, raising=False)
    df = spark.range(300).select(
        F.col("id").alias("event_id"), (F.col("id") % 7).alias("user_id"), F.col("id").alias("timestamp")
    )
    out = build_histories(df, {"ts": F.col("timestamp")}, ["event_id"], max_len=4)
    assert out.rdd.getNumPartitions() == 30  # the session has 8
    assert out.count() == 300


def test_carried_vectors_pool_as_the_join_does(spark):
    lists = [[5, 9, 5, 0, None, -3, 1 << 40], [], None, [7], [9] * 30, [3, 4]]
    df = spark.createDataFrame([(k, x, len(x or [])) for k, x in enumerate(lists)], "k int, ids array<long>, n int")
    vectors = spark.createDataFrame([(k, [k / 7, 1.0]) for k in (5, 7, 9, 11, 1 << 40)], "raw_id long, vector array<double>")
    table = pooling.carried(vectors, 2)
    one = df.select("k", pooling.sequence_mean(F.col("ids"), F.col("n"), table, 2).alias("s"), pooling.embed_mean(F.col("ids"), table, 2).alias("e"))
    seq = pooling.sequence_mean_pool(df, ["k"], "ids", "n", vectors, 2)
    emb = pooling.embed_mean_pool(df, ["k"], "ids", vectors, 2)
    both = {r["k"]: r for r in one.join(seq, "k").join(emb.withColumnRenamed("pooled", "other"), "k").collect()}
    assert len(both) == len(lists)
    for r in both.values():
        assert r["s"] == pytest.approx(r["pooled"]) and r["e"] == pytest.approx(r["other"])
    # The vectors are constants of the plan and not read again for every row.
    assert "from_json" not in one._jdf.queryExecution().optimizedPlan().toString()
    assert pooling.carried(vectors, 2, most_bytes=100) is None
    assert pooling.carried(vectors.unionByName(vectors.limit(1)), 2) is None
    assert pooling.carried(vectors.limit(0), 2).homes == 1


def test_scaling_of_known_length(spark):
    nan = float("nan")
    rows = [([1.0, -2.0, 3.0, 0.5], [1.0, 0.0, 1.0, 1.0]), ([1.0, 2.0], [1.0, 1.0]), (None, [1.0] * 4), ([nan, 5.0, 6.0, 7.0], [0.0, 1.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "v array<double>, p array<double>")
    stats = spark.createDataFrame([(k, 0.1 * k, 0.0 if k == 2 else 1.5) for k in range(4)], "pos long, mean double, std double")
    for log1p in (True, False):
        plain, known = (dense.zscore_apply(df, "v", "p", stats, log1p, ((1, 2),), dim).collect() for dim in (None, 4))
        assert repr(known) == repr(plain)


def test_window_pairs_agree_with_brute_force(spark):
    lists = [[1, 2, 1, 1, 3], [4], [2, 2], list(range(1, 12)), [9, 8, 7, 9, 8, 7]]
    df = spark.createDataFrame([("f" if k % 2 else "g", x) for k, x in enumerate(lists)], "feature string, tokens array<long>")
    want = Counter()
    for k, x in enumerate(lists):
        for i, a in enumerate(x):
            for b in x[i + 1 : i + 4]:
                want.update([("fg"[k % 2 == 0], a, b), ("fg"[k % 2 == 0], b, a)])
    rows = item2vec.window_pairs(df, 3)
    assert {(r["feature"], r["a"], r["b"]): r["n"] for r in rows.collect()} == want
    # A pair carries no list, whatever the length of its sentence.
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan
