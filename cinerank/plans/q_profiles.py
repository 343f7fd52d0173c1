"""Profile, shelf and aggregate queries over the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinerank.functions.columns import display_rating, genre_array
from cinerank.operators import profiles as P
from cinerank.operators import ranking as R
from cinerank.plans.registry import register
from cinerank.plans.sql_adapters import RATING_ORDER_SQL, clean_title_sql, var_sql, with_ctes, year_sql
from cinerank.sources import tables as T


def items(spark, d):
    return P.item_profiles(T.movies(spark, d), T.links(spark, d), T.ratings(spark, d))


ITEMS_SQL = f"""items AS (
  SELECT m.movieId, {clean_title_sql('m.title')} AS title, {year_sql('m.title', 0)} AS releaseYear,
         m.genres, l.imdbId, l.tmdbId,
         CAST(coalesce(s.n, 0) AS BIGINT) AS ratingNumber, coalesce(s.a, 0.0) AS averageRating
  FROM movies m LEFT JOIN links l USING (movieId)
  LEFT JOIN (SELECT movieId, count(*) AS n, avg(rating) AS a FROM ratings GROUP BY movieId) s USING (movieId))"""


def items_sql(body: str) -> str:
    """Adapters + the item-profile CTE, then the query body."""
    return with_ctes(body, "ratings", "movies", "links", extra=[ITEMS_SQL])


@register("genre_shelves", items_sql("""
SELECT genre, rank, movieId, title, releaseYear, ratingNumber, averageRating AS averageRating
FROM (SELECT g.genre, i.*, row_number() OVER (PARTITION BY g.genre ORDER BY i.averageRating DESC, i.movieId) AS rank
      FROM items i, unnest(string_split(i.genres, '|')) AS g(genre))
WHERE rank <= 8"""))
def q_genre_shelves(spark, d):
    """Every genre's shelf of 8 best-rated items (home-page rows)."""
    shelf = R.top_items_by_genre(items(spark, d), size=8, sort_by="rating")
    return shelf.select("genre", "rank", "movieId", "title", "releaseYear", "ratingNumber", "averageRating")


# The genres of the home page's six shelves, as a table: here the catalogue's
# genre words in capitals (there are six of them).
SHELF_SQL = """shelf AS (
  SELECT DISTINCT g.genre FROM movies, unnest(string_split(genres, '|')) AS g(genre)
  WHERE regexp_full_match(g.genre, '[A-Z]+'))"""


@register("home_shelves", with_ctes("""
SELECT genre, rank, movieId, averageRating AS averageRating
FROM (SELECT g.genre, i.*, row_number() OVER (PARTITION BY g.genre ORDER BY i.averageRating DESC, i.movieId) AS rank
      FROM items i, unnest(string_split(i.genres, '|')) AS g(genre) WHERE g.genre IN (SELECT genre FROM shelf))
WHERE rank <= 8""", "ratings", "movies", "links", extra=[ITEMS_SQL, SHELF_SQL]))
def q_home_shelves(spark, d):
    """The shelves of a table of genres (one column `genre`), 8 items each."""
    genres = T.movies(spark, d).select(F.explode(genre_array("genres")).alias("genre")).filter(F.col("genre").rlike("^[A-Z]+$"))
    shelf = R.top_items_by_genre(items(spark, d), size=8, sort_by="rating", genres=genres)
    return shelf.select("genre", "rank", "movieId", "averageRating")


@register("profiles_by_id", items_sql("""
SELECT 'item' AS kind, movieId AS id, ratingNumber AS ratings, averageRating AS average FROM items WHERE movieId % 7 = 0
UNION ALL
SELECT 'user', userId, count(*), avg(rating) FROM ratings WHERE userId % 7 = 0 GROUP BY userId"""))
def q_profiles_by_id(spark, d):
    """PF10: point lookups of item and user profiles for a table of ids (here
    every number divisible by 7 up to the largest id; unknown ids vanish)."""
    it, us = items(spark, d), P.user_profiles(T.ratings(spark, d))
    most = F.greatest(it.agg(F.max("movieId")).scalar(), us.agg(F.max("userId")).scalar())
    ids = spark.range(1).select(F.explode(F.sequence(F.lit(0).cast("long"), most, F.lit(7).cast("long"))).alias("id"))
    a = P.rows_by_id(it, ids.withColumnRenamed("id", "movieId"), "movieId").select(
        F.lit("item").alias("kind"), F.col("movieId").alias("id"), F.col("ratingNumber").alias("ratings"), F.col("averageRating").alias("average"))
    b = P.rows_by_id(us, ids.withColumnRenamed("id", "userId"), "userId").select(
        F.lit("user").alias("kind"), F.col("userId").alias("id"), F.col("ratingCount").alias("ratings"), F.col("averageRating").alias("average"))
    return a.unionByName(b)


@register("genre_page_by_year", items_sql("""
SELECT genre, rank, movieId, releaseYear
FROM (SELECT g.genre, i.*, row_number() OVER (PARTITION BY g.genre ORDER BY i.releaseYear DESC, i.movieId) AS rank
      FROM items i, unnest(string_split(i.genres, '|')) AS g(genre))
WHERE rank <= 100"""))
def q_genre_page_by_year(spark, d):
    """One-genre page (size 100) sorted by release year, for all genres."""
    page = R.top_items_by_genre(items(spark, d), size=100, sort_by="releaseYear")
    return page.select("genre", "rank", "movieId", "releaseYear")


@register("top_items_by_rating", items_sql("""
SELECT row_number() OVER (ORDER BY averageRating DESC, movieId) AS rank, movieId, averageRating AS averageRating
FROM items ORDER BY averageRating DESC, movieId LIMIT 100"""))
def q_top_items(spark, d):
    """The 100 best-rated items of the catalogue."""
    return R.top_items(items(spark, d), 100, "rating").select("rank", "movieId", "averageRating")


@register("item_profiles", items_sql("""
SELECT movieId, title, releaseYear, imdbId, tmdbId, genres, ratingNumber, averageRating AS averageRating
FROM items"""))
def q_item_profiles(spark, d):
    """A4 + J3 + PF3/PF4: item profiles."""
    return items(spark, d).select("movieId", "title", "releaseYear", "imdbId", "tmdbId", "genres",
                                  "ratingNumber", "averageRating")


@register("user_profiles", with_ctes("""
SELECT userId, avg(rating) AS averageRating, greatest(0.0, max(rating)) AS highestRating,
       least(5.0, min(rating)) AS lowestRating, count(*) AS ratingCount
FROM ratings GROUP BY userId""", "ratings"))
def q_user_profiles(spark, d):
    """A5: user profiles."""
    u = P.user_profiles(T.ratings(spark, d))
    return u.select("userId", "averageRating", "highestRating", "lowestRating", "ratingCount")


@register("top_ratings", with_ctes(f"""
SELECT movieId, rank, userId, rating, "timestamp" FROM (
  SELECT r.*, row_number() OVER (PARTITION BY movieId ORDER BY rating DESC, {RATING_ORDER_SQL}) AS rank
  FROM ratings r WHERE movieId IN (SELECT movieId FROM movies))
WHERE rank <= 10""", "ratings", "movies"))
def q_top_ratings(spark, d):
    """Each item's 10 best ratings."""
    t = P.top_ratings(T.ratings(spark, d), T.movies(spark, d), T.RATING_ORDER, 10)
    return t.select("movieId", "rank", "userId", "rating", "timestamp")


@register("rating_distribution", with_ctes("""
SELECT rating, count(*) AS count, count(*) / (SELECT count(*) FROM ratings) AS percentage
FROM ratings GROUP BY rating""", "ratings"))
def q_rating_distribution(spark, d):
    """A1: rating histogram with shares."""
    return P.rating_distribution(T.ratings(spark, d)).select("rating", "count", "percentage")


@register("rating_stats", with_ctes(f"""
SELECT movieId, count(*) AS ratingCount, avg(rating) AS avgRating, {var_sql('rating')} AS ratingVar
FROM ratings GROUP BY movieId""", "ratings"))
def q_rating_stats(spark, d):
    """A3: per-item count, mean, sample variance."""
    s = P.rating_stats(T.ratings(spark, d))
    return s.select("movieId", "ratingCount", "avgRating", "ratingVar")


@register("load_counts", with_ctes("""
SELECT 'movies' AS source, count(*) AS rows FROM movies
UNION ALL SELECT 'links_matched', count(*) FROM links WHERE movieId IN (SELECT movieId FROM movies)
UNION ALL SELECT 'ratings', count(*) FROM ratings
UNION ALL SELECT 'ratings_matched', count(*) FROM ratings WHERE movieId IN (SELECT movieId FROM movies)
UNION ALL SELECT 'users', count(DISTINCT userId) FROM ratings""", "ratings", "movies", "links"))
def q_load_counts(spark, d):
    """Audit counts per source."""
    return P.load_counts(T.ratings(spark, d), T.movies(spark, d), T.links(spark, d))


@register("item_page", items_sql(f"""
SELECT i.movieId, i.title, i.releaseYear, i.imdbId, i.tmdbId, i.genres, i.ratingNumber,
       i.averageRating AS averageRating,
       t.topRatings
FROM items i LEFT JOIN (
  SELECT movieId, string_agg(CAST(userId AS VARCHAR) || ':' || CAST(rating AS VARCHAR), ',' ORDER BY rank DESC) AS topRatings
  FROM (SELECT r.*, row_number() OVER (PARTITION BY movieId ORDER BY rating DESC, {RATING_ORDER_SQL}) AS rank
        FROM ratings r WHERE movieId IN (SELECT movieId FROM movies))
  WHERE rank <= 10 GROUP BY movieId) t USING (movieId)"""))
def q_item_page(spark, d):
    """Item detail = profile + links + top-10 ratings (list in the
    profile's ascending order: worst of the ten first)."""
    it = items(spark, d)
    top = P.top_ratings(T.ratings(spark, d), T.movies(spark, d), T.RATING_ORDER, 10)
    lists = top.groupBy("movieId").agg(F.array_sort(F.collect_list(F.struct(
        (-F.col("rank")).alias("k"),
        F.concat(F.col("userId").cast("string"), F.lit(":"), F.col("rating").cast("string")).alias("t")))).alias("l"))
    lists = lists.select("movieId", F.array_join(F.transform("l", lambda s: s["t"]), ",").alias("topRatings"))
    return it.join(lists, "movieId", "left").select(
        "movieId", "title", "releaseYear", "imdbId", "tmdbId", "genres", "ratingNumber", "averageRating",
        "topRatings")


@register("user_page", items_sql("""
SELECT r.userId, r.movieId, r.rating, r."timestamp", r.l_orderkey, r.l_linenumber, i.title, i.releaseYear,
       u.averageRating AS userAverageRating, u.ratingCount AS userRatingCount
FROM ratings r JOIN items i USING (movieId)
JOIN (SELECT userId, avg(rating) AS averageRating, count(*) AS ratingCount FROM ratings GROUP BY userId) u USING (userId)"""))
def q_user_page(spark, d):
    """R7 + J7: user profile joined to the user's rated items (history rows,
    ordered downstream by timestamp + tie-break)."""
    r = T.ratings(spark, d)
    u = P.user_profiles(r).select("userId", F.col("averageRating").alias("userAverageRating"),
                                  F.col("ratingCount").alias("userRatingCount"))
    it = items(spark, d).select("movieId", "title", "releaseYear")
    return (r.join(it, "movieId").join(u, "userId")
            .select("userId", "movieId", "rating", "timestamp", "l_orderkey", "l_linenumber", "title",
                    "releaseYear", "userAverageRating", "userRatingCount"))


_DISPLAY = ("CASE WHEN averageRating >= 1.0 "
            "THEN printf('%.1f', round(CAST(CAST(averageRating AS VARCHAR) AS DECIMAL(38, 18)), 1)) "
            "ELSE printf('%.2f', round(CAST(CAST(averageRating AS VARCHAR) AS DECIMAL(38, 18)), 2)) END")


@register("shelf_display", items_sql(f"""
SELECT genre, rank, movieId, {_DISPLAY} AS rating
FROM (SELECT g.genre, i.*, row_number() OVER (PARTITION BY g.genre ORDER BY i.averageRating DESC, i.movieId) AS rank
      FROM items i, unnest(string_split(i.genres, '|')) AS g(genre))
WHERE rank <= 8"""))
def q_shelf_display(spark, d):
    """PF12: shelf rows with the two-significant-digit rating text."""
    shelf = R.top_items_by_genre(items(spark, d), size=8, sort_by="rating")
    return shelf.select("genre", "rank", "movieId", display_rating("averageRating").alias("rating"))
