"""Source/sink queries: every write goes to a fresh folder in the session's
shared checkpoint storage and is read back; the oracle is the source table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cinerank.operators import samples as S
from cinerank.operators.sequences import positions
from cinerank.operators.profiles import item_profiles, top_ratings, user_profiles
from cinerank.plans.q_profiles import ITEMS_SQL, items
from cinerank.plans.q_samples import samples, samples_sql
from cinerank.functions.columns import parse_vector
from cinerank.plans.registry import ORACLES, register
from cinerank.plans.sql_adapters import RATING_ORDER_SQL, uniform_u32_sql, with_ctes
from cinerank.session import shared_path, write_once
from cinerank.sources import files as IO
from cinerank.sources import serialize as J
from cinerank.sources import store as ST
from cinerank.sources import tables as T
from cinerank.operators import candidates as C
from cinerank.plans.q_candidates import PAIRS100, SEEDG, _gtop


def _fresh(spark, name: str) -> str:
    return shared_path(spark, f"{name}-{uuid.uuid4().hex[:12]}")


@register("ratings_csv", with_ctes('SELECT userId, movieId, rating, "timestamp" FROM ratings', "ratings"))
def q_ratings_csv(spark, d):
    """IO1: ratings -> header CSV -> typed read."""
    path = _fresh(spark, "ratings-csv")
    IO.write_csv(T.ratings(spark, d).select("userId", "movieId", "rating", "timestamp"), path)
    return IO.read_ratings(spark, path)


@register("movies_csv", with_ctes("SELECT movieId, title, genres FROM movies", "movies"))
def q_movies_csv(spark, d):
    """IO2: movies -> CSV -> read (quoted fields kept)."""
    path = _fresh(spark, "movies-csv")
    IO.write_csv(T.movies(spark, d), path)
    return IO.read_movies(spark, path)


@register("links_csv", with_ctes("SELECT movieId, imdbId, tmdbId FROM links", "links"))
def q_links_csv(spark, d):
    """IO3: links -> CSV -> read; empty tmdbId reads back as null."""
    path = _fresh(spark, "links-csv")
    IO.write_csv(T.links(spark, d), path)
    return IO.read_links(spark, path)


@register("links_csv_strict", with_ctes("SELECT movieId, imdbId, tmdbId FROM links WHERE tmdbId IS NOT NULL", "links"))
def q_links_csv_strict(spark, d):
    """IO3 strict: lines with an empty tmdbId are dropped, as a comma
    splitter that ignores trailing empty fields would."""
    path = _fresh(spark, "links-strict")
    IO.write_csv(T.links(spark, d), path)
    return IO.read_links(spark, path, strict_columns=True)


@register("movies_csv_strict", with_ctes("SELECT movieId, title, genres FROM movies", "movies"))
def q_movies_csv_strict(spark, d):
    """IO2 strict: three comma-separated fields per line."""
    path = _fresh(spark, "movies-strict")
    IO.write_csv(T.movies(spark, d), path)
    return IO.read_movies(spark, path, strict_columns=True)


@register("embeddings_text", with_ctes("""
SELECT movieId, CAST(i AS INTEGER) AS dim, emb[i] AS value
FROM item_vectors, range(1, 65) AS r(i) WHERE i <= len(emb)""", "item_vectors"))
def q_embeddings_text(spark, d):
    """IO4 + IO5 + V2: vectors -> `id:f f f` text -> parsed back, exact."""
    path = _fresh(spark, "emb-text")
    IO.write_embeddings(T.item_vectors(spark, d), path)
    back = IO.read_embeddings(spark, path)
    return back.select("movieId", F.posexplode("emb").alias("pos", "value")).select(
        "movieId", (F.col("pos") + 1).alias("dim"), "value")


def _store_expiry(r):
    last = r.agg(F.max("timestamp")).scalar()
    return F.timestamp_seconds(last + F.lit(30 * 86400)), F.timestamp_seconds(last)


def _exploded(df):
    return df.select("key", F.explode("fields").alias("field", "value"))


_USER_UNPIVOT = " UNION ALL ".join(
    f"SELECT 'uf:' || CAST(userId AS VARCHAR) AS key, '{c}' AS field, coalesce(CAST({c} AS VARCHAR), '') AS value FROM lu"
    for c in S.USER_FEATURES)
_ITEM_UNPIVOT = " UNION ALL ".join(
    f"SELECT 'mf:' || CAST(movieId AS VARCHAR) AS key, '{c}' AS field, coalesce(CAST({c} AS VARCHAR), '') AS value FROM li"
    for c in S.ITEM_FEATURES)
_DESC = RATING_ORDER_SQL.replace(",", " DESC,") + " DESC"


@register("user_feature_store", samples_sql(_USER_UNPIVOT, extra=[
    f"lu AS (SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY userId ORDER BY {_DESC}) = 1)"]))
def q_user_feature_store(spark, d):
    """IO7 + IO10 + V12: newest user features -> `uf:` records in a fresh
    store -> prefix scan of live records, one row per field."""
    r = T.ratings(spark, d)
    expires, now = _store_expiry(r)
    store = ST.FeatureStore(spark, _fresh(spark, "store-u"))
    latest = S.latest_user_features(r, T.movies(spark, d), T.RATING_ORDER)
    ST.put_user_features(store, latest, S.USER_FEATURES, expires)
    return _exploded(store.get("uf:", now))


@register("item_feature_store", samples_sql(_ITEM_UNPIVOT, extra=[
    f"li AS (SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY movieId ORDER BY {_DESC}) = 1)"]))
def q_item_feature_store(spark, d):
    """IO8 + IO10: newest item features -> `mf:` records -> prefix scan."""
    r = T.ratings(spark, d)
    expires, now = _store_expiry(r)
    store = ST.FeatureStore(spark, _fresh(spark, "store-m"))
    latest = S.latest_item_features(r, T.movies(spark, d), T.RATING_ORDER)
    ST.put_item_features(store, latest, S.ITEM_FEATURES, expires)
    return _exploded(store.get("mf:", now))


@register("embedding_store", with_ctes("""
SELECT m.movieId, CAST(r.i AS INTEGER) AS dim,
       CASE WHEN m.movieId % 2 = 0 THEN v.emb[r.i] * 2 ELSE v.emb[r.i] END AS value
FROM movies m LEFT JOIN (SELECT * FROM item_vectors WHERE movieId % 5 <> 0) v USING (movieId)
LEFT JOIN range(1, 65) AS r(i) ON r.i <= len(v.emb)""", "movies", "item_vectors"))
def q_embedding_store(spark, d):
    """IO9 + IO11: vectors -> `i2vEmb:` records; a second put replaces the even
    ids by doubled vectors, a third one lets every fifth id expire; then a point
    lookup for every catalogue item, which must miss the expired ones."""
    expires, now = _store_expiry(T.ratings(spark, d))
    store = ST.FeatureStore(spark, _fresh(spark, "store-e"))
    v = T.item_vectors(spark, d)
    doubled = v.filter("movieId % 2 = 0").withColumn("emb", F.transform("emb", lambda x: (x * 2).cast("float")))
    ST.put_embeddings(store, v, "i2vEmb", "movieId", expires)
    ST.put_embeddings(store, doubled, "i2vEmb", "movieId", expires)
    ST.put_embeddings(store, v.filter("movieId % 5 = 0"), "i2vEmb", "movieId", now)
    got = store.lookup(T.movies(spark, d).select("movieId"), "i2vEmb:", "movieId", now)
    parsed = got.select("movieId", parse_vector(F.col("fields")["emb"]).alias("emb"))
    return parsed.select("movieId", F.posexplode_outer("emb").alias("pos", "value")).select(
        "movieId", (F.col("pos") + 1).cast("int").alias("dim"), "value")


@register("recommend_emb_store", ORACLES["recommend_emb"])
def q_recommend_emb_store(spark, d):
    """R4 + IO9 + IO11: user vectors are kept as `uEmb:` and item vectors as
    `i2vEmb:` records; the for-you list reads both back by point lookup."""
    r, it = T.ratings(spark, d), items(spark, d)
    expires, now = _store_expiry(r)
    store = ST.FeatureStore(spark, _fresh(spark, "store-r4"))
    ST.put_embeddings(store, T.user_vectors(spark, d), "uEmb", "userId", expires)
    ST.put_embeddings(store, T.item_vectors(spark, d), "i2vEmb", "movieId", expires)

    def vectors(ids, prefix, key):
        got = store.lookup(ids.select(key).distinct(), prefix, key, now)
        return got.select(key, parse_vector(F.col("fields")["emb"]).alias("emb"))

    out = C.recommend_for_users(r, it, size=32, model="emb", pool=800, user_vectors=vectors(r, "uEmb:", "userId"),
                                item_vectors=vectors(it, "i2vEmb:", "movieId"))
    return out.select("userId", "movieId", "score", "rank")


_SPLIT_KEY = ["userId", "movieId", "timestamp"] + T.TIE_BREAK
_SPLIT_SQL = uniform_u32_sql("userId", "movieId", '"timestamp"', *T.TIE_BREAK, "42")
_CSV_COLS = ["userId", "movieId", "label", "userRatingCount", "movieAvgRating", "userGenre1", "userRatedMovie1"]


@register("samples_csv", samples_sql(f"""
SELECT CASE WHEN u < 0.1 * 0.8 THEN 'train' ELSE 'test' END AS part, l_orderkey, l_linenumber, {", ".join(_CSV_COLS)}
FROM (SELECT *, {_SPLIT_SQL} / 4294967296.0 AS u FROM samples) WHERE u < 0.1"""))
def q_samples_csv(spark, d):
    """IO6: train/test split written as CSV folders and read back."""
    path = _fresh(spark, "samples-csv")
    written = S.split_samples(samples(spark, d, S.in_sample(_SPLIT_KEY, 0.1, 42)), _SPLIT_KEY, 0.1, (0.8, 0.2), seed=42)
    IO.write_samples(written, path)
    back = spark.read.schema(written.schema).option("header", True).csv(path)
    return back.select("part", "l_orderkey", "l_linenumber", *_CSV_COLS)


_RATING_JSON = "{'rating': {'movieId': movieId, 'userId': userId, 'score': CAST(rating AS FLOAT), 'timestamp': \"timestamp\"}}"


@register("item_json", with_ctes(f"""
SELECT i.movieId, to_json({{'movieId': i.movieId, 'title': i.title, 'releaseYear': i.releaseYear, 'imdbId': i.imdbId,
                            'tmdbId': i.tmdbId, 'genres': string_split(i.genres, '|'), 'ratingNumber': i.ratingNumber,
                            'averageRating': i.averageRating, 'topRatings': coalesce(t.l, [])}})::VARCHAR AS json
FROM items i LEFT JOIN (
  SELECT movieId, list({_RATING_JSON} ORDER BY rank DESC) AS l
  FROM (SELECT r.*, row_number() OVER (PARTITION BY movieId ORDER BY rating DESC, {RATING_ORDER_SQL}) AS rank
        FROM ratings r WHERE movieId IN (SELECT movieId FROM movies))
  WHERE rank <= 10 GROUP BY movieId) t USING (movieId)""", "ratings", "movies", "links", extra=[ITEMS_SQL]))
def q_item_json(spark, d):
    """IO12: item documents with their top-10 ratings."""
    top = top_ratings(T.ratings(spark, d), T.movies(spark, d), T.RATING_ORDER, 10)
    return J.item_json(items(spark, d), top)


@register("user_json", with_ctes(f"""
SELECT p.userId, p.page, to_json({{'userId': p.userId, 'averageRating': u.averageRating, 'highestRating': u.highestRating,
                                   'lowestRating': u.lowestRating, 'ratingCount': u.ratingCount, 'page': p.page,
                                   'pages': CAST(ceil(u.ratingCount / 1000) AS BIGINT), 'ratings': p.l}})::VARCHAR AS json
FROM (SELECT userId, CAST(pos // 1000 AS BIGINT) AS page, list({_RATING_JSON} ORDER BY pos) AS l
      FROM (SELECT r.*, row_number() OVER (PARTITION BY userId ORDER BY {RATING_ORDER_SQL}) - 1 AS pos FROM ratings r)
      GROUP BY userId, pos // 1000) p
JOIN (SELECT userId, avg(rating) AS averageRating, greatest(0.0, max(rating)) AS highestRating,
             least(5.0, min(rating)) AS lowestRating, count(*) AS ratingCount FROM ratings GROUP BY userId) u
  USING (userId)""", "ratings"))
def q_user_json(spark, d):
    """IO13: user documents with ratings in time order, paged."""
    r = T.ratings(spark, d)
    rated = positions(r, ["userId"], T.RATING_ORDER)
    return J.user_json(user_profiles(r), rated)


@register("list_json", with_ctes("""
SELECT seedId, to_json(list({'rank': rank, 'candidateId': candidateId, 'score': score} ORDER BY rank))::VARCHAR AS json
FROM (SELECT seedId, candidateId, score, row_number() OVER (PARTITION BY seedId ORDER BY score DESC, candidateId) AS rank
      FROM (SELECT seedId, candidateId,
                   (len(list_filter(string_split(seedGenres, '|'), lambda x: list_contains(string_split(candGenres, '|'), x)))::DOUBLE
                    / (len(string_split(seedGenres, '|')) + len(string_split(candGenres, '|')))::DOUBLE / 2.0) * 0.7
                   + 0.3 * (candAvg / 5.0) AS score FROM pairs))
WHERE rank <= 16 GROUP BY seedId""", "ratings", "movies", "links", extra=[ITEMS_SQL, _gtop(100), SEEDG, PAIRS100]))
def q_list_json(spark, d):
    """IO14: each item's similar-items list as a JSON array."""
    it = items(spark, d)
    ranked = C.similar_items(it.select("movieId"), it, size=16)
    return J.list_json(ranked, "seedId", ["candidateId", "score"])


@register("items_with_features", samples_sql(f"""
SELECT i.movieId, i.title, li.movieAvgRating, li.movieRatingCount
FROM items i LEFT JOIN (
  SELECT movieId, movieAvgRating, CAST(movieRatingCount AS VARCHAR) AS movieRatingCount FROM samples
  QUALIFY row_number() OVER (PARTITION BY movieId ORDER BY {_DESC}) = 1) li USING (movieId)""",
                                            extra=[ITEMS_SQL]))
def q_items_with_features(spark, d):
    """J6 + IO8: catalogue items joined to their stored `mf:` features."""
    r = write_once(T.ratings(spark, d), "ratings")  # read by four aggregates
    expires, now = _store_expiry(r)
    store = ST.FeatureStore(spark, _fresh(spark, "store-j6"))
    ST.put_item_features(store, S.latest_item_features(r, T.movies(spark, d), T.RATING_ORDER), S.ITEM_FEATURES, expires)
    it = item_profiles(T.movies(spark, d), T.links(spark, d), r)
    j = ST.attach_features(it.select("movieId", "title"), store, "mf:", "movieId", now)
    return j.select("movieId", "title", F.col("fields")["movieAvgRating"].alias("movieAvgRating"),
                    F.col("fields")["movieRatingCount"].alias("movieRatingCount"))


@register("rating_lists", with_ctes(f"""
SELECT userId, row_number() OVER (PARTITION BY userId ORDER BY {RATING_ORDER_SQL}) - 1 AS pos,
       movieId, rating, "timestamp"
FROM ratings""", "ratings"))
def q_rating_lists(spark, d):
    """Every user's ratings in time order as (userId, pos) rows; the
    list form is built from bounded pages (see user_json)."""
    p = positions(T.ratings(spark, d), ["userId"], T.RATING_ORDER)
    return p.select("userId", "pos", "movieId", "rating", "timestamp")


@register("item_rating_lists", with_ctes(f"""
SELECT movieId, row_number() OVER (PARTITION BY movieId ORDER BY {RATING_ORDER_SQL}) - 1 AS pos,
       userId, rating, "timestamp"
FROM ratings WHERE movieId IN (SELECT movieId FROM movies)""", "ratings", "movies"))
def q_item_rating_lists(spark, d):
    """A7, item side: every catalogue item's ratings in time order as
    (movieId, pos) rows."""
    known = T.ratings(spark, d).join(T.movies(spark, d).select("movieId"), "movieId", "left_semi")
    p = positions(known, ["movieId"], T.RATING_ORDER)
    return p.select("movieId", "pos", "userId", "rating", "timestamp")


@register("csv_rejects", with_ctes("""
SELECT CAST(userId AS VARCHAR) || ',' || CAST(movieId AS VARCHAR) || ',x,' || CAST("timestamp" AS VARCHAR) AS line
FROM ratings WHERE l_linenumber = 1""", "ratings"))
def q_csv_rejects(spark, d):
    """IO1: lines with a rating that is no number are left out of the ratings
    and come back from the quarantine reader."""
    path = _fresh(spark, "ratings-bad")
    r = T.ratings(spark, d).filter("l_linenumber = 1")
    IO.write_csv(r.select("userId", "movieId", F.lit("x").alias("rating"), "timestamp"), path)
    return IO.csv_rejects(spark, path, IO.RATINGS_SCHEMA)
