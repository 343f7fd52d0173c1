"""Encoders: hand fixtures and exact quantile cut points."""

import random

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cinerank.operators import encoders as E


def test_min_max_scaler_fixture(spark):
    rows = [(1, [1.0, 0.1, -1.0]), (2, [2.0, 1.1, 1.0]), (3, [3.0, 10.1, 3.0])]
    df = spark.createDataFrame(rows, "id int, f array<double>").withColumn("v", array_to_vector("f"))
    out = E.min_max_scale(df, "v", "s").select("id", vector_to_array("s").alias("s")).orderBy("id").collect()
    got = [[round(x, 9) for x in r.s] for r in out]
    assert got == [[0.0, 0.0, 0.0], [0.5, 0.1, 0.5], [1.0, 1.0, 1.0]]


def test_one_hot_size_is_max_plus_one(spark):
    df = spark.createDataFrame([(0,), (3,)], "movieId long")
    out = E.one_hot(df, "movieId").select("movieId", F.size(vector_to_array("vec")).alias("n"), E.hot_index("vec").alias("i"))
    assert sorted(map(tuple, out.collect())) == [(0, 4, 0), (3, 4, 3)]


def test_exact_splits_equal_zero_error_discretizer(spark):
    random.seed(7)
    vals = [(float(random.choice([1, 2, 2, 3, 5, 8, 8, 8, 13, 21, random.randint(0, 60)])),) for _ in range(777)]
    df = spark.createDataFrame(vals, "x double")
    for n in (4, 10, 100):
        ref = QuantileDiscretizer(numBuckets=n, inputCol="x", outputCol="b", relativeError=0.0).fit(df)
        assert E.exact_splits(df, "x", n) == list(ref.getSplits()), n


def test_multi_hot_popcount_equals_distinct_genres(spark):
    m = spark.createDataFrame([(1, "t", "A|B"), (2, "u", "B"), (3, "v", "C|A|B")], "movieId long, title string, genres string")
    out = E.multi_hot(m).select("movieId", "genreIndexes", "indexSize",
                                F.size(F.filter(vector_to_array("vector"), lambda x: x > 0)).alias("hot"))
    rows = {r.movieId: r for r in out.collect()}
    assert rows[3].hot == 3 and rows[2].hot == 1 and rows[1].indexSize == 3
    assert rows[2].genreIndexes == [0]  # B is the most frequent genre
