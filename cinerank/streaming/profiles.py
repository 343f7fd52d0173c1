"""Incremental profiles with Structured Streaming.

The online side of a recommender updates item and user profiles one rating
at a time as ratings arrive. Here that is a streaming aggregation: rating
files appear in a folder, a stateful groupBy keeps per-user (or per-item)
sums, extremes and counts in the state store, and every micro-batch upserts
the changed profiles into the feature store (foreachBatch, update mode).
State, checkpoints and the store live in shared storage, so a restarted
query resumes where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinerank.sources.files import RATINGS_SCHEMA
from cinerank.sources.store import FeatureStore, keyed

USER_FIELDS = ["averageRating", "highestRating", "lowestRating", "ratingCount"]


def rating_stream(spark: SparkSession, folder: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Ratings (userId, movieId, rating, timestamp) as parquet files arriving
    in `folder`."""
    return (spark.readStream.schema(RATINGS_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(folder))


def user_profile_updates(ratings: DataFrame) -> DataFrame:
    """Streaming A5: per-user running mean, clamped extremes and count."""
    return ratings.groupBy("userId").agg(
        (F.sum("rating") / F.count(F.lit(1))).alias("averageRating"),
        F.greatest(F.lit(0.0), F.max("rating")).alias("highestRating"),
        F.least(F.lit(5.0), F.min("rating")).alias("lowestRating"),
        F.count(F.lit(1)).alias("ratingCount"))


def start_profile_sink(updates: DataFrame, store: FeatureStore, prefix: str, id_col: str, fields: list[str],
                       checkpoint: str, expires_at=None, available_now: bool = True):
    """Upsert every micro-batch's changed profiles (re-running a batch after a
    failure puts the same records again)."""
    exp = expires_at if expires_at is not None else F.lit("9999-12-31").cast("timestamp")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        store.put(keyed(batch, prefix, id_col, fields, exp))

    w = updates.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(upsert)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def profiles_from_store(store: FeatureStore, prefix: str, id_col: str) -> DataFrame:
    """Read user profiles back from the store as typed columns."""
    cur = store.get(prefix, F.lit("1970-01-01").cast("timestamp"))
    f = F.col("fields")
    return cur.select(F.col("id").cast("long").alias(id_col),
                      f["averageRating"].cast("double").alias("averageRating"),
                      f["highestRating"].cast("double").alias("highestRating"),
                      f["lowestRating"].cast("double").alias("lowestRating"),
                      f["ratingCount"].cast("long").alias("ratingCount"))
