import math
import random

import numpy as np
import pytest

from tidemark.operators import metrics

NAN = float("nan")


def rank_auc(rows):
    pos = [s for s, y in rows if y]
    neg = [s for s, y in rows if not y]
    won = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return won / (len(pos) * len(neg))


@pytest.mark.parametrize("kind", ["ties", "fine", "tiny", "outside", "mixed"])
def test_auc_is_exact(spark, kind):
    rnd = random.Random(kind)
    draw = {
        "ties": lambda: rnd.randrange(5) / 5,
        "fine": lambda: 0.5 + rnd.randrange(50) * 2.0**-50,
        "tiny": lambda: rnd.random() * 1e-12,
        "outside": lambda: rnd.gauss(0, 100),
        "mixed": lambda: rnd.choice([0.0, 1.0, rnd.random(), 2.0**-18, 3 * 2.0**-36]),
    }[kind]
    rows = [(draw(), int(rnd.random() < 0.3)) for _ in range(400)]
    df = spark.createDataFrame(rows, "s double, y int")
    assert metrics.auc(df, "s", "y").first().auc == pytest.approx(rank_auc(rows), abs=1e-12)


def test_auc_degenerate(spark):
    for rows in ([], [(0.5, 1)], [(0.1, 0), (0.2, 0)]):
        assert metrics.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first().auc == 0.0
    tied = spark.createDataFrame([(0.3, 1), (0.3, 0)] * 4, "s double, y int")
    assert metrics.auc(tied, "s", "y").first().auc == 0.5


def bce(x, y):
    return max(x, 0) - x * y + math.log1p(math.exp(-abs(x)))


def test_evaluate_drops_nan(spark):
    rows = [(0.3, 1), (NAN, 0), (-2.0, 0), (1.5, 0), (2.5, 1), (NAN, 1)]
    kept = [r for r in rows if r[0] == r[0]]
    out = metrics.evaluate(spark.createDataFrame(rows, "logit double, label int")).first()
    assert out.auc == pytest.approx(rank_auc(kept))
    assert out.logloss == pytest.approx(np.mean([bce(x, y) for x, y in kept]))
    none = metrics.evaluate(spark.createDataFrame([(NAN, 1)], "logit double, label int")).first()
    assert none.auc == 0.0 and none.logloss == math.inf


def test_focal_loss(spark):
    rows = [(0.3, 1), (-2.0, 0), (1.5, 0)]

    def one(x, y, a=0.1, g=2.0):
        p = 1 / (1 + math.exp(-x))
        pt = p if y else 1 - p
        return (a if y else 1 - a) * (1 - pt) ** g * bce(x, y)

    df = spark.createDataFrame(rows, "logit double, label int")
    terms = [one(x, y) for x, y in rows]
    assert metrics.focal_loss(df).first()[0] == pytest.approx(np.mean(terms))
    assert metrics.focal_loss(df, reduction="sum").first()[0] == pytest.approx(sum(terms))
    each = metrics.focal_loss(df, gamma=0.0, alpha=0.5, reduction="none").collect()
    assert [r.focal_loss for r in each] == pytest.approx([bce(x, y) / 2 for x, y in rows])
    with pytest.raises(ValueError):
        metrics.focal_loss(df, reduction="max")


def test_pairwise_auc_loss(spark):
    rnd = random.Random(4)
    # Block 1 has no positive row and gives none.
    rows = [(i, rnd.gauss(0, 2), 0 if 10 <= i < 20 else i % 2) for i in range(33)]
    df = spark.createDataFrame(rows, "p bigint, logit double, label int")
    got = {r.block: (r.pairs, r.loss) for r in metrics.pairwise_auc_loss(df, "p", block_rows=10).collect()}
    want = {}
    for b in (0, 2, 3):
        block = [r for r in rows if r[0] // 10 == b]
        pairs = [math.log1p(math.exp(n[1] - q[1])) for q in block if q[2] for n in block if not n[2]]
        want[b] = (len(pairs), pytest.approx(np.mean(pairs)))
    assert got == want


def test_blocks_need_unique_positions(spark):
    df = spark.createDataFrame([(0, 0.5, 1)] * 5, "p bigint, logit double, label int")
    with pytest.raises(Exception, match="positions are not unique"):
        metrics.pairwise_auc_loss(df, "p", block_rows=4).collect()


def supcon(z, y, anchors):
    z = z / np.linalg.norm(z, axis=1, keepdims=True)
    total = []
    for i in anchors:
        mates = [j for j in range(len(y)) if j != i and y[j] == y[i]]
        if mates:
            sims = [z[i] @ z[j] / 0.1 for j in range(len(y)) if j != i]
            total.append(-np.mean([z[i] @ z[j] / 0.1 - np.logaddexp.reduce(sims) for j in mates]))
    return np.mean(total) if total else 0.0


@pytest.mark.parametrize("positives_only", [False, True])
def test_contrastive_loss(spark, positives_only):
    rng = np.random.default_rng(0)
    z, y = rng.normal(size=(25, 4)), rng.integers(0, 3, size=25)
    y[20:] = [0, 2, 5, 7, 9]
    rows = [(i, z[i].tolist(), int(y[i])) for i in range(25)]
    df = spark.createDataFrame(rows, "p bigint, vector array<double>, label int")
    got = {
        r.block: r.loss
        for r in metrics.contrastive_loss(df, "p", block_rows=10, positives_only=positives_only).collect()
    }
    for b in range(3):
        part = slice(10 * b, 10 * b + 10)
        anchors = [i for i, v in enumerate(y[part]) if not positives_only or v == 1]
        assert got[b] == pytest.approx(supcon(z[part], y[part], anchors), abs=1e-9)
    assert got[2] == 0.0
