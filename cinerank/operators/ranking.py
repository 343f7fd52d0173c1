"""Sorts, limits and top-k.

Top-k per group is `row_number() <= k` over a window, which Spark plans as a
partial WindowGroupLimit before the shuffle: a hot group is cut to k rows per
map partition, so no task ever sees a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinerank.functions.columns import genre_array

SORT_KEYS = {"rating": "averageRating", "releaseYear": "releaseYear"}


def top_k(df: DataFrame, group_cols: list, order: list[Column], k: int, rank_col: str = "rank") -> DataFrame:
    """Keep the first k rows of each group under `order`; adds a 1-based rank."""
    w = Window.partitionBy(*group_cols).orderBy(*order) if group_cols else Window.orderBy(*order)
    ranked = df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= k)
    return ranked.withColumn(rank_col, F.col(rank_col).cast("long"))


def item_order(sort_by: str) -> list[Column]:
    """Ordering of items for a shelf: by average rating or release year,
    descending, then id; any other key keeps id order."""
    key = SORT_KEYS.get(sort_by)
    return ([F.col(key).desc()] if key else []) + [F.col("movieId").asc()]


def top_items(items: DataFrame, size: int = 100, sort_by: str = "rating") -> DataFrame:
    """The first `size` items of the whole catalogue (TakeOrdered)."""
    ranked = items.orderBy(*item_order(sort_by)).limit(size)
    return top_k(ranked, [], item_order(sort_by), size)


def genre_items(items: DataFrame) -> DataFrame:
    """Genre -> item rows (the inverted index as a table; blank genres
    have no entry)."""
    return items.select(F.explode(genre_array("genres")).alias("genre"), *items.columns)


def top_items_by_genre(items: DataFrame, size: int = 100, sort_by: str = "rating",
                       genres: DataFrame | None = None) -> DataFrame:
    """Per genre the first `size` items; `genres` (one column `genre`)
    restricts the genres, unknown genres give no rows."""
    g = genre_items(items)
    if genres is not None:
        g = g.join(genres.select("genre").distinct(), "genre", "left_semi")
    return top_k(g, ["genre"], item_order(sort_by), size)
