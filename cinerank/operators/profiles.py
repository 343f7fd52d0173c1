"""Item and user profiles, rating aggregates (A1-A7, A16, J3-J7, PF10, R6, R7).

Per-key aggregates are plain groupBy/agg: Spark combines partially on the
map side, so a key holding a third of all ratings costs one partial row per
map partition, never a whole-group task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinerank.functions.columns import clean_title, release_year, sample_var
from cinerank.operators.ranking import top_k


def add_label(ratings: DataFrame, threshold: float = 3.5) -> DataFrame:
    """PF1: label 1 when rating >= threshold else 0."""
    return ratings.withColumn("label", F.when(F.col("rating") >= threshold, F.lit(1)).otherwise(F.lit(0)))


def positive_ratings(ratings: DataFrame, threshold: float = 3.5) -> DataFrame:
    """PF2: liked rows only."""
    return ratings.filter(F.col("rating") >= threshold)


def rating_distribution(ratings: DataFrame) -> DataFrame:
    """A1 + T5: count and share of each rating value, ordered by value. The
    total is the sum over the few distinct values, so ratings are read once."""
    counts = ratings.groupBy("rating").agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("percentage", F.col("count") / total).orderBy("rating")


def rating_stats(ratings: DataFrame) -> DataFrame:
    """A3: per item count, mean and sample variance (null for one rating)."""
    return ratings.groupBy("movieId").agg(
        F.count(F.lit(1)).alias("ratingCount"),
        F.avg("rating").alias("avgRating"),
        sample_var("rating").alias("ratingVar"))


def items_with_links(movies: DataFrame, links: DataFrame) -> DataFrame:
    """J3 + PF3/PF4: catalogue rows with parsed title/year and external ids.
    A title without a year keeps the whole text and year 0 (online parse)."""
    m = movies.select(
        "movieId",
        clean_title("title").alias("title"),
        release_year("title", 0).alias("releaseYear"),
        "genres")
    return m.join(links.select("movieId", "imdbId", "tmdbId"), "movieId", "left")


def item_profiles(movies: DataFrame, links: DataFrame, ratings: DataFrame) -> DataFrame:
    """A4: catalogue + ratingNumber and averageRating (0 when unrated).
    Ratings of unknown items are ignored (J4)."""
    stats = ratings.groupBy("movieId").agg(
        F.count(F.lit(1)).alias("ratingNumber"), F.avg("rating").alias("averageRating"))
    return (items_with_links(movies, links).join(stats, "movieId", "left")
            .withColumn("ratingNumber", F.coalesce("ratingNumber", F.lit(0)).cast("long"))
            .withColumn("averageRating", F.coalesce("averageRating", F.lit(0.0))))


def user_profiles(ratings: DataFrame) -> DataFrame:
    """A5: mean, highest (floor 0), lowest (cap 5.0) and count per user."""
    return ratings.groupBy("userId").agg(
        F.avg("rating").alias("averageRating"),
        F.greatest(F.lit(0.0), F.max("rating")).alias("highestRating"),
        F.least(F.lit(5.0), F.min("rating")).alias("lowestRating"),
        F.count(F.lit(1)).alias("ratingCount"))


def top_ratings(ratings: DataFrame, movies: DataFrame, order_cols: list[str], k: int = 10) -> DataFrame:
    """Per item its k best ratings; on equal scores the earlier rating
    stays (rank 1 = best). Only catalogue items have lists."""
    known = ratings.join(movies.select("movieId"), "movieId", "left_semi")
    return top_k(known, ["movieId"], [F.col("rating").desc()] + [F.col(c).asc() for c in order_cols], k)


def load_counts(ratings: DataFrame, movies: DataFrame, links: DataFrame) -> DataFrame:
    """Rows per source, rows that found their item, and users. A rating
    counts for its item's and its user's key, so one aggregation over one read
    of every source gives all counts."""
    def keyed(df: DataFrame, source: str, *keys: Column) -> DataFrame:
        return df.select(F.explode(F.array(*keys)).alias("k")).select("k.*", F.lit(source).alias("s"))

    def key(kind: str, col: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(col).cast("long").alias("key"))

    per_key = (keyed(movies, "movies", key("item", "movieId")).unionByName(keyed(links, "links", key("item", "movieId")))
               .unionByName(keyed(ratings, "ratings", key("item", "movieId"), key("user", "userId")))
               .groupBy("kind", "key").agg(*[F.count(F.when(F.col("s") == s, 1)).alias(s) for s in ("movies", "links", "ratings")]))
    item = F.col("kind") == "item"
    known = item & (F.col("movies") > 0) & F.col("key").isNotNull()
    counts = per_key.agg(
        F.sum("movies").alias("movies"), F.sum(F.when(known, F.col("links"))).alias("links_matched"),
        F.sum(F.when(item, F.col("ratings"))).alias("ratings"), F.sum(F.when(known, F.col("ratings"))).alias("ratings_matched"),
        F.count(F.when(~item, F.col("key"))).alias("users"))
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("source"), F.coalesce(c, F.lit(0)).cast("long").alias("rows"))
                                             for c in counts.columns])).alias("r")).select("r.*")


def rows_by_id(profiles: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """PF10: point lookup of item or user profiles for a table of ids (unknown
    ids vanish, repeated ids give one row)."""
    return profiles.join(ids.select(key), key, "left_semi")
