"""Streaming query: user profiles maintained incrementally from rating
files derived from the driver tables."""

from __future__ import annotations

import uuid


from cinerank.plans.registry import register
from cinerank.plans.sql_adapters import with_ctes
from cinerank.session import shared_path
from cinerank.sources import tables as T
from cinerank.sources.store import FeatureStore
from cinerank.streaming import profiles as SP


@register("stream_user_profiles", with_ctes("""
SELECT userId, avg(rating) AS averageRating, greatest(0.0, max(rating)) AS highestRating,
       least(5.0, min(rating)) AS lowestRating, count(*) AS ratingCount
FROM ratings GROUP BY userId""", "ratings"))
def q_stream_user_profiles(spark, d):
    """Streaming A5: ratings land as files in time order; a stateful streaming
    aggregation upserts changed user profiles into the feature store per
    micro-batch (at most four of them); the store is read back."""
    run = shared_path(spark, f"stream-{uuid.uuid4().hex[:12]}")
    r = T.ratings(spark, d).select("userId", "movieId", "rating", "timestamp")
    ranged = r.repartitionByRange("timestamp")
    ranged.write.parquet(f"{run}/in")
    files = len(spark.read.parquet(f"{run}/in").inputFiles())
    store = FeatureStore(spark, f"{run}/store")
    q = SP.start_profile_sink(SP.user_profile_updates(SP.rating_stream(spark, f"{run}/in", max(1, -(-files // 4)))), store, "up:",
                              "userId", SP.USER_FIELDS, f"{run}/ckpt")
    q.awaitTermination()
    return SP.profiles_from_store(store, "up:", "userId")
