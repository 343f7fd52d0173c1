"""Categorical and numeric feature encoders (M1-M5, A8-A10, V6, V7, V9,
V10), on Spark ML where it has the encoder.

Exact quantile buckets come from the counts of distinct values and their
running sum instead of a zero-error quantile summary, which would merge all
values on the driver; only the <= n cut values are fetched.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import (Bucketizer, CountVectorizerModel, MinMaxScaler, OneHotEncoder, QuantileDiscretizer, StringIndexer,
                                VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinerank.functions.columns import genre_array, sample_var
from cinerank.operators.sequences import running_sum

def hot_index(vec_col: str) -> Column:
    """Place of the 1 in a one-hot vector (null for an all-zero one)."""
    v = vector_to_array(vec_col)
    at = F.array_position(v, F.lit(1.0)).cast("int") - 1
    return F.when(at >= 0, at)


def one_hot(df: DataFrame, col: str, out_col: str = "vec", drop_last: bool = False) -> DataFrame:
    """M1 + PF11: integer id -> one-hot vector of size max+1."""
    d = df.withColumn(col + "Number", F.col(col).cast("int"))
    enc = OneHotEncoder(inputCols=[col + "Number"], outputCols=[out_col], dropLast=drop_last)
    return enc.fit(d).transform(d)


def explode_genres(movies: DataFrame) -> DataFrame:
    """V9: one row per (movie, genre); blank genres have none."""
    return movies.select("movieId", "title", F.explode(genre_array("genres")).alias("genre"))


def _indexer(df: DataFrame, col: str, out_col: str):
    return StringIndexer(inputCol=col, outputCol=out_col + "_d", stringOrderType="frequencyDesc").fit(df)


def label_index(df: DataFrame, col: str, out_col: str) -> DataFrame:
    """Value -> index by frequency desc, value asc, from 0 (StringIndexer)."""
    return _indexer(df, col, out_col).transform(df).withColumn(out_col, F.col(out_col + "_d").cast("int")).drop(out_col + "_d")


def multi_hot(movies: DataFrame) -> DataFrame:
    """M2: V9 -> A8 -> A9 -> A10 -> V10 -> V6: per item its genre indexes,
    the index size and a sparse 0/1 vector over all genres."""
    g = explode_genres(movies)
    model = _indexer(g, "genre", "genreIndex")
    g = model.transform(g).withColumn("genreIndex", F.col("genreIndex_d").cast("int"))
    size = g.agg((F.max("genreIndex") + 1).alias("n")).scalar()            # A9, as a scalar subquery
    per_item = g.groupBy("movieId").agg(F.sort_array(F.collect_list("genreIndex")).alias("genreIndexes"),  # A10
                                        F.collect_list("genre").alias("_genres"))
    per_item = per_item.withColumn("indexSize", size)                      # V10
    if not model.labels:
        return per_item.withColumn("vector", array_to_vector(F.array().cast("array<double>"))).drop("_genres")
    hot = CountVectorizerModel.from_vocabulary(list(model.labels), inputCol="_genres", outputCol="vector").setBinary(True)
    return hot.transform(per_item).drop("_genres")                         # V6


def _rank_cut(q: float, n_rows: int) -> int:
    """1-based rank of the q-quantile in an exact summary: ceil(q * n)."""
    return max(1, math.ceil(q * n_rows))


def exact_splits(df: DataFrame, col: str, num_buckets: int) -> list[float]:
    """Cut points of QuantileDiscretizer(relativeError=0): -inf, the values
    at ranks ceil(i/n * N) for i = 1..n-1, +inf, equal cuts merged."""
    vals = df.select(F.col(col).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    n_rows = vals.count()
    if n_rows == 0:
        return [-math.inf, math.inf]
    ranks = [_rank_cut(i / num_buckets, n_rows) for i in range(1, num_buckets)]
    # ranks (lo, hi] belong to a value; ties cost one row however many there are
    counts = running_sum(vals.groupBy("_v").agg(F.count(F.lit(1)).alias("_n")), [], ["_v"], "_n", "_lo")
    want = F.array(*[F.lit(r).cast("long") for r in sorted(set(ranks))])
    cuts = counts.select("_v", F.explode(F.filter(want, lambda r: (r > F.col("_lo")) & (r <= F.col("_lo") + F.col("_n")))).alias("r"))
    by_rank = {x["r"]: x["_v"] for x in cuts.collect()}  # at most num_buckets rows
    splits = [-math.inf] + [0.0 if by_rank[r] == 0 else by_rank[r] for r in ranks] + [math.inf]
    return list(dict.fromkeys(splits))


def quantile_bucket(df: DataFrame, col: str, out_col: str, num_buckets: int = 100, exact: bool = True,
                    relative_error: float = 0.001) -> DataFrame:
    """M3: quantile buckets of a numeric column; equal cut points merge.
    exact=False uses QuantileDiscretizer's bounded-memory summary."""
    if exact:
        b = Bucketizer(splits=exact_splits(df, col, num_buckets), inputCol=col + "_d", outputCol=out_col)
        return b.transform(df.withColumn(col + "_d", F.col(col).cast("double"))).drop(col + "_d")
    qd = QuantileDiscretizer(numBuckets=num_buckets, inputCol=col, outputCol=out_col,
                             relativeError=relative_error)
    return qd.fit(df).transform(df)


def dense_vector(df: DataFrame, col: str, out_col: str) -> DataFrame:
    """V7: scalar -> one-element dense vector."""
    return VectorAssembler(inputCols=[col], outputCol=out_col).transform(df)


def min_max_scale(df: DataFrame, vec_col: str, out_col: str) -> DataFrame:
    """M4: per dimension to [0, 1]; a constant dimension maps to 0.5."""
    return MinMaxScaler(inputCol=vec_col, outputCol=out_col).fit(df).transform(df)


def numeric_features(ratings: DataFrame, num_buckets: int = 100) -> DataFrame:
    """M5: per-item rating count, mean and variance (A3); count -> quantile
    bucket (M3); mean -> 1-vector (V7) -> min-max scaled (M4)."""
    stats = ratings.groupBy("movieId").agg(
        F.count(F.lit(1)).alias("ratingCount"), F.avg("rating").alias("avgRating"),
        sample_var("rating").alias("ratingVar"))
    stats = dense_vector(stats, "avgRating", "avgRatingVec")
    stats = quantile_bucket(stats, "ratingCount", "ratingCountBucket", num_buckets)
    scaled = min_max_scale(stats, "avgRatingVec", "scaleAvgRatingVec")
    return scaled.withColumn("scaleAvgRating", F.get(vector_to_array("scaleAvgRatingVec"), 0))

