"""The pool ranked by a model's score, against brute force."""

import random

from pyspark.sql import functions as F

from cinerank.operators.candidates import recommend_by_model


def test_pool_ranked_by_any_score(spark):
    r = random.Random(3)
    rated = [(i, round(r.uniform(0, 5), 1)) for i in range(40)]
    items = spark.createDataFrame([(i, a, 2000, "Drama") for i, a in rated], "movieId long, averageRating double, releaseYear int, genres string")
    users = spark.createDataFrame([(u,) for u in (1, 2, 2, 5)], "userId long")
    score = lambda df: df.withColumn("score", F.pmod(F.col("userId") * 7 + F.col("movieId") * 3, F.lit(5)).cast("double"))
    got = {}
    for x in recommend_by_model(users, items, score, size=6, pool=15).orderBy("userId", "rank").collect():
        got.setdefault(x.userId, []).append((x.movieId, x.score, x.rank))
    pool = [i for i, _ in sorted(rated, key=lambda x: (-x[1], x[0]))[:15]]
    for u in (1, 2, 5):
        best = sorted(((float((u * 7 + i * 3) % 5), i) for i in pool), key=lambda x: (-x[0], x[1]))[:6]
        assert got[u] == [(i, s, k) for k, (s, i) in enumerate(best, 1)]
    assert set(got) == {1, 2, 5}
    plan = recommend_by_model(users, items, score)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and plan.count("Exchange hashpartitioning(userId") == 1  # of users, not of pairs
    few = recommend_by_model(users, items.limit(2), score, size=6, pool=15)
    assert few.groupBy("userId").count().agg(F.max("count")).first()[0] == 2
    assert recommend_by_model(users.limit(0), items, score).count() == 0
