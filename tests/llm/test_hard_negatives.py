"""Hard-negative mining against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinerank.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int"


def by_hand(rows, every=5, positives=5, negatives=3, low=50, high=95):
    real = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows
            if i is not None and y is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, v, y) in enumerate(real):
        if i % every:
            continue
        scored = [(-sum(p * q for p, q in zip(v, w)), j, z) for b, (j, w, z) in enumerate(real) if b != a and len(v) == len(w)]
        for s, j, _ in sorted(x for x in scored if x[2] == y)[:positives]:
            inside = sorted(x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s)[:negatives]
            out += [(i, j, k, n, -s, -t) for k, (t, n, _) in enumerate(inside, 1)]
    return sorted(out)


def run(df, **options):
    return sorted(tuple(r) for r in hn.mine(df, **options).collect())


def sample(n=150, dims=12, labels=4, seed=2):
    r = random.Random(seed)
    centre = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    rows = [(i, [r.gauss(0.3, 0.3) + c for c in centre[i % labels]], i % labels) for i in range(n)]
    rows += [(i, rows[5][1], y) for i, y in ((5, 1), (1000, 1), (1005, 2), (5, 1))]  # repeated rows, ids and vectors
    rows += [(2000, [0.0] * dims, 1), (2005, [-x for x in rows[0][1]], 0)]
    return rows


ODD = [(None, [1.0] * 12, 1), (3000, None, 1), (3005, [1.0] * 11 + [None], 1), (3010, [float("nan")] * 12, 2),
       (3015, [float("inf")] * 12, 0), (3020, [1.0] * 12, None), (3025, [], 1), (3030, [1.0, 2.0], 1), (3035, [1.5, 2.0], 1),
       (3040, [1.0, 1.0], 0), (3045, [0.5] * 12, 77)]


@pytest.mark.parametrize("options", [{}, {"block_rows": 16, "block_anchors": 7}, {"n_positives": 2, "n_negatives": 7, "low": 10, "high": 100}])
def test_negatives_by_hand(spark, options, monkeypatch):
    rows = sample() + ODD
    df = spark.createDataFrame(rows, SCHEMA).withColumn("uid", F.lit("x")).withColumn("a", F.lit(1)).repartition(3)
    by = {"n_positives": "positives", "n_negatives": "negatives"}
    want = by_hand(rows, **{by.get(k, k): v for k, v in options.items() if not k.startswith("block")})
    assert run(df, anchor=F.col("id") % 5 == 0, **options) == want and len(want) > 50


def test_the_scan_prunes_and_loses_nothing():
    r = np.random.default_rng(5)
    vectors = np.floor(256 * r.normal(0, 1, (3000, 32)) * np.linspace(4, 0.05, 32))
    label = np.arange(3000) % 3
    label[:40] = 9  # a label with few rows
    parts = hn.ByLabel(label, vectors, np.arange(3000))
    for a in (0, 100, 2999):
        score = vectors @ vectors[a]
        same = np.flatnonzero(label == label[a])
        rows, got = hn.scan(parts.of(int(label[a])), vectors[a], [(-np.inf, np.inf)], 6)
        assert (got == score[rows]).all() and set(rows) >= set(same[np.argsort(-score[same])[:6]]) and len(rows) < len(same)
        top = int(np.sort(score[same])[-2])
        window = hn.window_of(top)
        rows, got = hn.scan(parts.others(int(label[a])), vectors[a], [window], 3)
        inside = [i for i in np.flatnonzero(label != label[a]) if 50 * top <= 100 * score[i] <= 95 * top]
        assert set(sorted(inside, key=lambda i: -score[i])[:3]) <= set(rows) and (got == score[rows]).all()


def test_large_components_stay_exact(spark):
    big = float(2 ** 30)
    rows = [(0, [big, 1.0], 1), (1, [big, 3.0], 1), (2, [big, 2.0], 1), (3, [big * 0.75, 1.0], 2), (4, [big * 0.75, 2.0], 2)]
    assert run(spark.createDataFrame(rows, SCHEMA), anchor=F.col("id") == 0, scale=1) == by_hand(
        [(i, [x / 256 for x in v], y) for i, v, y in rows], every=100)
    huge = [(i, [3e38 * (i + 1) / 9], i % 2) for i in range(8)]
    assert run(spark.createDataFrame(huge, SCHEMA), anchor=F.col("id") == 0) == []  # beyond 64 bits: no window holds them


def test_nothing_to_mine(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []
    assert run(spark.createDataFrame([(50, [1.0], 1)], SCHEMA)) == []
    assert run(spark.createDataFrame([(50, [1.0], 1), (51, [1.0], 1)], SCHEMA)) == []
    assert run(spark.createDataFrame([(51, [1.0], 1), (52, [1.0], 2)], SCHEMA)) == []
