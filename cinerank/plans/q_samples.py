"""Training-sample queries (flagship) and the latest-row feature exports."""

from __future__ import annotations


from cinerank.operators import samples as S
from cinerank.plans.registry import register
from cinerank.plans.sql_adapters import RATING_ORDER_SQL, uniform_u32_sql, var_sql, with_ctes, year_sql
from cinerank.sources import tables as T

SAMPLE_COLS = (["userId", "movieId", "rating", "timestamp"] + T.TIE_BREAK[:2] + ["label"] + S.ITEM_FEATURES
               + S.USER_FEATURES)
SAMPLE_COLS = list(dict.fromkeys(SAMPLE_COLS))

_SAMPLES_CTE = f"""s1 AS (
  SELECT r.*, CASE WHEN r.rating >= 3.5 THEN 1 ELSE 0 END AS label,
         {year_sql('m.title', 1990)} AS releaseYear, m.genres,
         string_split(m.genres, '|')[1] AS movieGenre1, string_split(m.genres, '|')[2] AS movieGenre2,
         string_split(m.genres, '|')[3] AS movieGenre3
  FROM ratings r LEFT JOIN movies m USING (movieId)),
st AS (
  SELECT movieId, count(*) AS movieRatingCount, format('{{:,.2f}}', avg(rating)) AS movieAvgRating,
         format('{{:,.2f}}', coalesce(sqrt({var_sql('rating')}), 0.0)) AS movieRatingStddev
  FROM s1 GROUP BY movieId),
s3 AS (
  SELECT s1.*, st.movieRatingCount, st.movieAvgRating, st.movieRatingStddev,
         list_filter(list(CASE WHEN label = 1 THEN movieId END) OVER w, lambda x: x IS NOT NULL) AS hist,
         count(*) OVER w AS userRatingCount,
         avg(releaseYear) OVER w AS ary, sqrt({var_sql('releaseYear', ' OVER w')}) AS sry,
         avg(rating) OVER w AS ar, sqrt({var_sql('rating', ' OVER w')}) AS sr,
         flatten(list_transform(
            list_filter(list(CASE WHEN label = 1 THEN genres END) OVER w, lambda x: x IS NOT NULL),
            lambda g: string_split(g, '|'))) AS flat
  FROM s1 LEFT JOIN st USING (movieId)
  WINDOW w AS (PARTITION BY userId ORDER BY {RATING_ORDER_SQL} ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)),
s4 AS (
  SELECT *, list_transform(list_sort(list_transform(list_distinct(flat),
              lambda x: {{'neg': -len(list_filter(flat, lambda y: y = x)), 'genre': x}})), lambda s: s.genre) AS ug
  FROM s3),
samples AS (
  SELECT userId, movieId, rating, "timestamp", l_orderkey, l_linenumber, label, releaseYear,
         movieGenre1, movieGenre2, movieGenre3, movieRatingCount, movieAvgRating, movieRatingStddev,
         hist[1] AS userRatedMovie1, hist[2] AS userRatedMovie2, hist[3] AS userRatedMovie3,
         hist[4] AS userRatedMovie4, hist[5] AS userRatedMovie5,
         userRatingCount, CAST(coalesce(trunc(ary), 0) AS INTEGER) AS userAvgReleaseYear,
         format('{{:,.2f}}', coalesce(sry, 0.0)) AS userReleaseYearStddev,
         format('{{:,.2f}}', ar) AS userAvgRating,
         format('{{:,.2f}}', coalesce(sr, 0.0)) AS userRatingStddev,
         ug[1] AS userGenre1, ug[2] AS userGenre2, ug[3] AS userGenre3, ug[4] AS userGenre4, ug[5] AS userGenre5,
         l_suppkey, l_quantity, l_extendedprice
  FROM s4 WHERE userRatingCount > 1)"""


def samples_sql(body: str, extra: list[str] | None = None) -> str:
    """Adapters + the training-sample CTE chain (+ extra CTEs), then body."""
    return with_ctes(body, "ratings", "movies", "links", extra=[_SAMPLES_CTE, *(extra or [])])


def samples(spark, d, only=None):
    return S.training_samples(T.ratings(spark, d), T.movies(spark, d), T.RATING_ORDER, only=only)


@register("training_samples", samples_sql("SELECT " + ", ".join(SAMPLE_COLS) + " FROM samples"))
def q_training_samples(spark, d):
    """Flagship: labelled samples with item features and 100-rating user
    history windows."""
    return samples(spark, d).select(*SAMPLE_COLS)


@register("latest_user_features", samples_sql(f"""
SELECT userId, {', '.join(f"coalesce(CAST({c} AS VARCHAR), '')" + f' AS {c}' if c.startswith('userGenre') else c
                          for c in S.USER_FEATURES)}
FROM samples QUALIFY row_number() OVER (PARTITION BY userId ORDER BY {RATING_ORDER_SQL.replace(',', ' DESC,')} DESC) = 1"""))
def q_latest_user_features(spark, d):
    """Each user's newest sample row (user feature export)."""
    return S.latest_user_features(T.ratings(spark, d), T.movies(spark, d), T.RATING_ORDER)


@register("latest_item_features", samples_sql(f"""
SELECT movieId, releaseYear, coalesce(movieGenre1, '') AS movieGenre1, coalesce(movieGenre2, '') AS movieGenre2,
       coalesce(movieGenre3, '') AS movieGenre3, movieRatingCount, movieAvgRating, movieRatingStddev
FROM samples QUALIFY row_number() OVER (PARTITION BY movieId ORDER BY {RATING_ORDER_SQL.replace(',', ' DESC,')} DESC) = 1"""))
def q_latest_item_features(spark, d):
    """Each item's newest sample row (item feature export)."""
    return S.latest_item_features(T.ratings(spark, d), T.movies(spark, d), T.RATING_ORDER)


_KEY = ["userId", "movieId", "timestamp"] + T.TIE_BREAK
_KEY_SQL = ["userId", "movieId", '"timestamp"'] + T.TIE_BREAK


@register("split_samples", samples_sql(f"""
SELECT userId, movieId, "timestamp", l_orderkey, l_linenumber, label,
       CASE WHEN u < 0.1 * 0.8 THEN 'train' ELSE 'test' END AS part
FROM (SELECT *, {uniform_u32_sql(*_KEY_SQL, '42')} / 4294967296.0 AS u FROM samples)
WHERE u < 0.1"""))
def q_split_samples(spark, d):
    """Reproducible 10% sample split 80/20 into train and test."""
    sp = S.split_samples(samples(spark, d, S.in_sample(_KEY, 0.1, 42)), _KEY, 0.1, (0.8, 0.2), seed=42)
    return sp.select("userId", "movieId", "timestamp", "l_orderkey", "l_linenumber", "label", "part")
