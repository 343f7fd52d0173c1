"""Feature-encoder queries over the catalogue and ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cinerank.operators import encoders as E
from cinerank.plans.registry import register
from cinerank.plans.sql_adapters import var_sql, with_ctes
from cinerank.sources import tables as T


@register("one_hot_items", with_ctes("""
SELECT movieId, CAST(movieId AS INTEGER) AS hotIndex, CAST((SELECT max(movieId) + 1 FROM movies) AS INTEGER) AS vecSize
FROM movies""", "movies"))
def q_one_hot(spark, d):
    """M1: one-hot item id vectors (checked through their sparse parts)."""
    v = E.one_hot(T.movies(spark, d), "movieId", "vec")
    # a one-hot vector is dense text once expanded, so its place is checked on
    # the vector itself and its size on the schema that the encoder wrote
    size = v.schema["vec"].metadata["ml_attr"]["num_attrs"]
    return v.select("movieId", F.col("movieIdNumber").alias("hotIndex"), F.lit(size).cast("int").alias("vecSize"))


GENRE_INDEX_SQL = """gi AS (
  SELECT genre, CAST(row_number() OVER (ORDER BY n DESC, genre) - 1 AS INTEGER) AS genreIndex
  FROM (SELECT genre, count(*) AS n FROM movies, unnest(string_split(genres, '|')) AS g(genre) GROUP BY genre))"""


@register("genre_index", with_ctes("SELECT genre, genreIndex FROM gi", "movies", extra=[GENRE_INDEX_SQL]))
def q_genre_index(spark, d):
    """Genre -> index by frequency (StringIndexer)."""
    g = E.label_index(E.explode_genres(T.movies(spark, d)), "genre", "genreIndex")
    return g.select("genre", "genreIndex").distinct()


@register("multi_hot_genres", with_ctes("""
SELECT m.movieId, string_agg(CAST(gi.genreIndex AS VARCHAR), ',' ORDER BY gi.genreIndex) AS genreIndexes,
       (SELECT max(genreIndex) + 1 FROM gi) AS indexSize,
       '(' || (SELECT max(genreIndex) + 1 FROM gi) || ',[' || string_agg(CAST(gi.genreIndex AS VARCHAR), ',' ORDER BY gi.genreIndex)
           || '],[' || string_agg('1.0', ',') || '])' AS sparse
FROM movies m, unnest(string_split(m.genres, '|')) AS g(genre) JOIN gi USING (genre)
GROUP BY m.movieId""", "movies", extra=[GENRE_INDEX_SQL]))
def q_multi_hot(spark, d):
    """M2 + A9 + A10 + V6 + V10: sparse multi-hot genre vectors per item, as
    (size,[indices],[values])."""
    m = E.multi_hot(T.movies(spark, d))
    return m.select("movieId", F.array_join("genreIndexes", ",").alias("genreIndexes"), "indexSize",
                    F.col("vector").cast("string").alias("sparse"))


NUMERIC_SQL = f"""st AS (
  SELECT movieId, count(*) AS ratingCount, avg(rating) AS avgRating, {var_sql('rating')} AS ratingVar
  FROM ratings GROUP BY movieId),
ranked AS (SELECT ratingCount, row_number() OVER (ORDER BY ratingCount) AS rk FROM st),
nn AS (SELECT count(*) AS n FROM st),
cuts AS (
  SELECT DISTINCT CAST(r.ratingCount AS DOUBLE) AS cut
  FROM range(1, 100) AS t(i), nn, ranked r
  WHERE r.rk = greatest(1, CAST(ceil((t.i::DOUBLE / 100.0) * nn.n) AS BIGINT))),
mm AS (SELECT min(avgRating) AS lo, max(avgRating) AS hi FROM st)"""


@register("numeric_features", with_ctes("""
SELECT s.movieId, s.ratingCount, s.avgRating, s.ratingVar,
       CAST((SELECT count(*) FROM cuts c WHERE c.cut <= s.ratingCount) AS DOUBLE) AS ratingCountBucket,
       CASE WHEN mm.hi = mm.lo THEN 0.5 ELSE (s.avgRating - mm.lo) * (1.0 / (mm.hi - mm.lo)) + 0.0 END AS scaleAvgRating
FROM st s, mm""", "ratings", extra=[NUMERIC_SQL]))
def q_numeric_features(spark, d):
    """M5 (A3 + V7 + M3 + M4): rating-count quantile buckets (100) and
    min-max scaled mean rating per item."""
    f = E.numeric_features(T.ratings(spark, d))
    return f.select("movieId", "ratingCount", "avgRating", "ratingVar",
                    "ratingCountBucket", "scaleAvgRating")
