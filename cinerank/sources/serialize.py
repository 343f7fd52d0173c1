"""JSON forms of items, users and ranked lists (IO12-IO14, V13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinerank.functions.columns import genre_array

JSON_OPTS = {"ignoreNullFields": "false"}  # nulls written out, as a default object mapper does

def _rating_entry():
    """One rating as {"rating": {movieId, userId, score, timestamp}}."""
    s = F.struct("movieId", "userId", F.col("rating").cast("float").alias("score"), "timestamp")
    return F.struct(s.alias("rating"))


def item_json(items: DataFrame, top: DataFrame) -> DataFrame:
    """IO12: item -> JSON with genres list and its top ratings, each wrapped
    as {"rating": {...}}, worst of the top first (profile order)."""
    lists = top.groupBy("movieId").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("rank")).alias("k"), _rating_entry().alias("r")))).alias("_l"))
    lists = lists.select("movieId", F.transform("_l", lambda e: e["r"]).alias("topRatings"))
    j = items.join(lists, "movieId", "left")
    doc = F.struct("movieId", "title", "releaseYear", "imdbId", "tmdbId", genre_array("genres").alias("genres"),
                   "ratingNumber", "averageRating",
                   F.coalesce("topRatings", F.array().cast(lists.schema["topRatings"].dataType)).alias("topRatings"))
    return j.select("movieId", F.to_json(doc, JSON_OPTS).alias("json"))


def user_json(users: DataFrame, rated: DataFrame, page_size: int = 1000) -> DataFrame:
    """IO13: user -> JSON pages: profile fields, the page's number and the
    user's number of pages, and up to `page_size` ratings in time order (`pos`
    from skew-safe positions), so a very active user becomes several bounded
    rows that name each other."""
    r = rated.withColumn("page", F.floor(F.col("pos") / page_size).cast("long"))
    pages = r.groupBy("userId", "page").agg(F.sort_array(F.collect_list(F.struct(
        F.col("pos").alias("k"), _rating_entry().alias("r")))).alias("_l"))
    pages = pages.select("userId", "page", F.transform("_l", lambda e: e["r"]).alias("ratings"))
    n_pages = F.ceil(F.col("ratingCount") / page_size).cast("long")
    j = users.withColumn("pages", n_pages).join(pages, "userId")
    doc = F.struct("userId", "averageRating", "highestRating", "lowestRating", "ratingCount", "page", "pages", "ratings")
    return j.select("userId", "page", F.to_json(doc, JSON_OPTS).alias("json"))


def list_json(ranked: DataFrame, query_col: str, item_cols: list[str]) -> DataFrame:
    """IO14: ranked list per query (bounded by its size) -> JSON array."""
    l = ranked.groupBy(query_col).agg(F.sort_array(F.collect_list(F.struct("rank", *item_cols))).alias("_l"))
    return l.select(query_col, F.to_json("_l", JSON_OPTS).alias("json"))
