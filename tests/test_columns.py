"""Column functions against small restatements."""

import bisect
import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidemark.fixed_values import HOLIDAYS, RECENCY_EDGES
from tidemark.functions import arrays, ids, maths, timefeat
from tidemark.operators.assemble import branch_vectors, group_ids, plan_branches, plan_groups
from tidemark.schema import FeatureLayout


def collect(spark, rows, schema, *columns):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_clean_id_edges(spark):
    rows = [(None,), (-1,), (0,), (1,), (39,), (40,), (41,)]
    out = collect(
        spark, rows, "x bigint", ids.clean_id(F.col("x"), 40), ids.clean_id(F.col("x"), 0)
    )
    assert out == [(0, 0), (0, 0), (0, 0), (1, 0), (39, 0), (0, 0), (0, 0)]


def test_hash_bucket_and_label(spark):
    out = collect(spark, [(0,), (-3,), (1,), (7,), (8,)], "x bigint", ids.hash_bucket(F.col("x"), 7))
    assert out == [(0,), (0,), (2,), (1,), (2,)]
    labels = collect(
        spark, [(None,), (0,), (1,), (2,), (3,)], "x int", ids.derive_label(F.col("x"))
    )
    assert labels == [(0,), (0,), (0,), (1,), (0,)]


LISTS = [None, [], [5], [1, -1, None, 0, 7], [3, 2, 1], [9, 8, 7, 6, 5, 4]]


def random_lists(n, values):
    rnd = random.Random(7)
    return [[rnd.choice(values) for _ in range(rnd.randrange(9))] for _ in range(n)]


@pytest.mark.parametrize("n", [1, 3, 5])
def test_pad_int_list(spark, n):
    rows = [(x,) for x in LISTS + random_lists(60, [None, -2, -1, 0, 1, 2, 50])]
    c = F.col("x")
    out = collect(
        spark, rows, "x array<bigint>",
        arrays.pad_int_list(c, n), arrays.pad_id_list(c, n, 8), arrays.list_length(c, n),
    )
    for (x,), (padded, bounded, length) in zip(rows, out):
        head = (x or [])[:n]
        want = [v if v and v > 0 else 0 for v in head] + [0] * (n - len(head))
        assert padded == want
        assert bounded == [v if v < 8 else 0 for v in want]
        assert length == len(head)


def test_pad_float_list_with_presence(spark):
    special = [None, float("nan"), float("inf"), float("-inf"), -1.5, 0.0, 2.25]
    rows = [(None,), ([],)] + [(x,) for x in random_lists(60, special)]
    values, presence = arrays.pad_float_list_with_presence(F.col("x"), 4)
    out = collect(spark, rows, "x array<double>", values, presence)
    for (x,), (v, p) in zip(rows, out):
        head = (x or [])[:4]
        ok = [e is not None and math.isfinite(e) for e in head]
        pad = 4 - len(head)
        assert v == [e if k else 0.0 for e, k in zip(head, ok)] + [0.0] * pad
        assert p == [float(k) for k in ok] + [0.0] * pad


def test_slices_and_masks(one):
    v = F.array(*[F.lit(float(i)) for i in range(5)])
    assert one(arrays.take_range(v, 3, 7)) == [3.0, 4.0, 0.0, 0.0]
    assert one(arrays.take_range(v, 9, 11)) == [0.0, 0.0]
    assert one(arrays.padding_mask(F.lit(2), 4)) == [False, False, True, True]
    assert one(arrays.padding_mask(F.lit(9), 2)) == [False, False]
    seq = F.array(*[F.lit(i).cast("long") for i in (9, 8, 7, 0, 0)])
    assert one(arrays.most_recent_k(seq, F.lit(3), 2)) == [9, 8]
    assert one(arrays.most_recent_k(seq, F.lit(1), 3)) == [9, 0, 0]
    assert one(arrays.most_recent_k_mask(F.lit(1), 3)) == [False, True, True]


def test_valid_tokens_filters_before_truncating(one):
    x = F.array(*[F.lit(i).cast("long") for i in (0, -1, 4, 0, 5, 6)])
    assert one(arrays.valid_tokens(x, 2)) == [4, 5]


def bucket(age):
    return min(bisect.bisect_left(RECENCY_EDGES, max(age, 0)), len(RECENCY_EDGES) - 1) + 1


def test_recency_every_edge(spark):
    assert len(RECENCY_EDGES) == 63 and list(RECENCY_EDGES) == sorted(RECENCY_EDGES)
    now = 1_760_000_000
    ages = sorted({e + d for e in RECENCY_EDGES for d in (-1, 0, 1)} | {0, -50, 40_000_000})
    rows = [(now - a,) for a in ages]
    out = collect(
        spark, rows, "t bigint",
        timefeat.recency_bucket(F.lit(now), F.col("t")),
        timefeat.recency_bucket_seq(F.lit(now), F.array("t"), pad_to=2),
    )
    assert out == [(bucket(a), [bucket(a), 0]) for a in ages]


def test_recency_special_times(one):
    now = F.lit(1_760_000_000).cast("long")
    assert one(timefeat.recency_bucket(now, F.lit(0).cast("long"))) == 0
    assert one(timefeat.recency_bucket(now, F.lit(None).cast("long"))) == 0
    assert one(timefeat.recency_bucket(now, F.lit(-1).cast("long"))) == 63


def calendar(ts, zone):
    if ts <= 0:
        return (0, 0, 0)
    t = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=ts + int(zone * 3600))
    return (t.hour + 1, t.weekday() + 1, bisect.bisect_right([6, 11, 14, 18, 22], t.hour) + 1)


def day_type(ts, zone):
    if ts <= 0:
        return (0, 0)
    t = dt.datetime(1970, 1, 1) + dt.timedelta(seconds=ts + int(zone * 3600))
    return (2 if t.weekday() >= 5 else 1, 2 if t.date().isoformat() in HOLIDAYS else 1)


@pytest.mark.parametrize("zone", [8.0, 0.0, -3.5, 5.75, -11.0])
def test_calendar_and_day_type(spark, zone):
    rnd = random.Random(3)
    start = int(dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc).timestamp())
    times = [start + h * 3600 for h in range(24 * 9)] + [start + h * 3600 - 1 for h in range(48)]
    times += [rnd.randrange(1, 2_000_000_000) for _ in range(200)] + [1, 3600, 0, -1, -100_000]
    for day in HOLIDAYS + ("2026-02-22", "2025-01-27", "2025-02-05"):
        t = int(dt.datetime.fromisoformat(day + "T00:00:00+00:00").timestamp())
        times += [t - 1, t, t + 57_600, t + 86_399]
    c = timefeat.calendar_ids(F.col("t"), zone)
    d = timefeat.day_type(F.col("t"), zone)
    out = collect(
        spark, [(t,) for t in times], "t bigint", c, d,
        timefeat.calendar_ids_seq(F.array("t"), zone, pad_to=2),
        timefeat.day_type_seq(F.array("t"), zone, pad_to=2),
    )
    for t, (got_c, got_d, seq_c, seq_d) in zip(times, out):
        assert tuple(got_c) == calendar(t, zone), t
        assert tuple(got_d) == day_type(t, zone), t
        assert [tuple(x) for x in seq_c] == [calendar(t, zone), (0, 0, 0)]
        assert [tuple(x) for x in seq_d] == [day_type(t, zone), (0, 0)]


def test_cyclical_time(one):
    v = one(timefeat.cyclical_time(F.lit(7), F.lit(1)))
    assert v == pytest.approx([1.0, 0.0, 0.0, 1.0], abs=1e-12)
    assert one(timefeat.cyclical_time(F.lit(0), F.lit(0))) == [0.0] * 4


def test_value_transforms(one):
    x = F.lit(-3.0)
    assert one(maths.signed_log1p(x)) == pytest.approx(-math.log(4))
    assert one(maths.log1p_nonneg(x)) == 0.0
    assert one(maths.safe_ratio(F.lit(3), F.lit(0))) == 0.0
    assert one(maths.softplus(F.lit(800.0))) == 800.0
    assert one(maths.bce_with_logit(F.lit(-800.0), F.lit(1.0))) == 800.0
    with pytest.raises(ValueError):
        maths.transform_array(F.array(x), "sqrt")


LAYOUT = FeatureLayout(()).with_features("user_dense", [(61, 2, 0), (62, 1, 0), (9, 1, 0)])


def test_branches(one):
    spec = (("counts", (62, 63), "log1p_nonneg"), ("gone", (5,), "raw"), ("a", (61,), "signed_log1p"))
    assert plan_branches(LAYOUT, "user_dense", spec) == [
        ("counts", [62], "log1p_nonneg"), ("a", [61], "signed_log1p"), ("dense_other", [9], "raw"),
    ]
    v = F.array(*[F.lit(x) for x in (-1.0, 1.0, 3.0, 7.0)])
    row = one(branch_vectors(v, LAYOUT, "user_dense", spec, transform=True))
    assert row["counts"] == pytest.approx([math.log(4)])
    assert row["a"] == pytest.approx([-math.log(2), math.log(2)])
    assert row["dense_other"] == [7.0]
    with pytest.raises(ValueError):
        plan_branches(LAYOUT, "user_dense", (("a", (61,), "cube"),))


def test_calendar_branch_is_the_rest_branch():
    wide = LAYOUT.with_calendar()
    plan = plan_branches(wide, "user_dense", (("a", (61, 62, 9), "raw"),))
    assert plan[-1] == ("dense_other", [990000, 990001, 990002, 990003], "raw")
    groups = FeatureLayout(()).with_features("user_int", [(1, 1, 5), (3, 2, 5)]).with_calendar()
    assert plan_groups(groups, "user_int", {"A": [3], "B": [1]}) == {"A": [1], "B": [0, 2, 3, 4]}


def test_groups(one):
    layout = FeatureLayout(()).with_features("user_int", [(1, 1, 5), (3, 2, 5)])
    v = F.array(*[F.lit(x).cast("long") for x in (4, 2, 3)])
    assert one(group_ids(v, layout, "user_int", {"g": [3, 1]}))["g"] == [2, 3, 4]
    with pytest.raises(ValueError):
        plan_groups(layout, "user_int", {"g": [8]})


def test_short_and_long_lists_are_padded_alike(spark, monkeypatch):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([([1.5, nan, inf, -inf, None, -0.25],), ([],), (None,), ([2.0] * 9,)], "v array<float>")
    short = df.select(*arrays.pad_float_list_with_presence(F.col("v"), 6)).collect()
    assert [list(x) for x in short[0]] == [[1.5, 0.0, 0.0, 0.0, 0.0, -0.25], [1.0, 0.0, 0.0, 0.0, 0.0, 1.0]]
    monkeypatch.setattr(arrays, "UNROLLED", 0)
    assert df.select(*arrays.pad_float_list_with_presence(F.col("v"), 6)).collect() == short
