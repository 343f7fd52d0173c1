"""Candidate recall and ranking queries: every item is a seed, every rating
user gets a list (whole tables)."""

from __future__ import annotations


from cinerank.operators import candidates as C
from cinerank.plans.q_profiles import ITEMS_SQL, items
from cinerank.plans.registry import register
from cinerank.plans.sql_adapters import cosine_sql, with_ctes
from cinerank.sources import tables as T


def _sql(body: str, *extra: str) -> str:
    return with_ctes(body, "ratings", "movies", "links", "item_vectors", "user_vectors",
                     extra=[ITEMS_SQL, *extra])


def _gtop(n: int) -> str:
    return f"""gtop{n} AS (
  SELECT genre, movieId AS candidateId, genres AS candGenres, averageRating AS candAvg FROM (
    SELECT g.genre, i.*, row_number() OVER (PARTITION BY g.genre ORDER BY i.averageRating DESC, i.movieId) AS rk
    FROM items i, unnest(string_split(i.genres, '|')) AS g(genre)) WHERE rk <= {n})"""


SEEDG = """seedg AS (
  SELECT i.movieId AS seedId, i.genres AS seedGenres, g.genre
  FROM items i, unnest(string_split(i.genres, '|')) AS g(genre))"""

PAIRS100 = """pairs AS (
  SELECT DISTINCT s.seedId, t.candidateId, s.seedGenres, t.candGenres, t.candAvg
  FROM seedg s JOIN gtop100 t USING (genre) WHERE t.candidateId <> s.seedId)"""


def _ranked(scored: str, key: str, cand: str, size: int) -> str:
    return f"""SELECT {key}, {cand}, score AS score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY score DESC, {cand}) AS rank FROM {scored})
WHERE rank <= {size}"""


GENRE_SIM = """(len(list_filter(string_split(seedGenres, '|'), lambda x: list_contains(string_split(candGenres, '|'), x)))::DOUBLE
   / (len(string_split(seedGenres, '|')) + len(string_split(candGenres, '|')))::DOUBLE / 2.0)"""


@register("similar_items_default", _sql(_ranked(f"""(
  SELECT seedId, candidateId, {GENRE_SIM} * 0.7 + 0.3 * (candAvg / 5.0) AS score FROM pairs)""",
                                               "seedId", "candidateId", 16),
                                       _gtop(100), SEEDG, PAIRS100))
def q_similar_default(spark, d):
    """Similar items by genre overlap and rating, 16 per item."""
    it = items(spark, d)
    r = C.similar_items(it.select("movieId"), it, size=16, model="default")
    return r.select("seedId", "candidateId", "score", "rank")


@register("similar_items_emb", _sql(_ranked(f"""(
  SELECT p.seedId, p.candidateId, {cosine_sql('sv.emb', 'cv.emb')} AS score
  FROM pairs p LEFT JOIN item_vectors sv ON sv.movieId = p.seedId
  LEFT JOIN item_vectors cv ON cv.movieId = p.candidateId)""", "seedId", "candidateId", 16),
                                    _gtop(100), SEEDG, PAIRS100))
def q_similar_emb(spark, d):
    """R2: genre candidates ranked by vector cosine, 16 per item."""
    it = items(spark, d)
    r = C.similar_items(it.select("movieId"), it, size=16, model="emb", vectors=T.item_vectors(spark, d))
    return r.select("seedId", "candidateId", "score", "rank")


@register("candidates_by_genre", _sql("""
SELECT DISTINCT s.seedId, t.candidateId FROM seedg s JOIN gtop100 t USING (genre) WHERE t.candidateId <> s.seedId""",
                                      _gtop(100), SEEDG))
def q_candidates_by_genre(spark, d):
    """Per-genre top-100 recall for every item."""
    it = items(spark, d)
    return C.candidate_ids(it.select("movieId"), it, 100)


@register("candidates_multi", _sql("""
SELECT DISTINCT seedId, candidateId FROM (
  SELECT s.seedId, t.candidateId FROM seedg s JOIN gtop20 t USING (genre)
  UNION ALL
  SELECT i.movieId, t.movieId FROM items i,
    (SELECT movieId FROM items ORDER BY averageRating DESC, movieId LIMIT 100) t
  UNION ALL
  SELECT i.movieId, t.movieId FROM items i,
    (SELECT movieId FROM items ORDER BY releaseYear DESC, movieId LIMIT 100) t)
WHERE seedId <> candidateId""", _gtop(20), SEEDG))
def q_candidates_multi(spark, d):
    """Multi-route recall (genre top 20, top 100 by rating, top 100 by
    year) for every item."""
    it = items(spark, d)
    return C.candidates_multi(it.select("movieId"), it).select("seedId", "candidateId")


POOL = """pool AS (
  SELECT movieId, row_number() OVER (ORDER BY averageRating DESC, movieId) AS prank FROM items
  QUALIFY prank <= {n})"""


@register("candidates_by_embedding", _sql(_ranked(f"""(
  SELECT q.movieId AS seedId, p.movieId AS candidateId, {cosine_sql('q.emb', 'v.emb')} AS score
  FROM (SELECT * FROM item_vectors WHERE movieId IN (SELECT movieId FROM items)) q,
       pool p LEFT JOIN item_vectors v ON v.movieId = p.movieId)""", "seedId", "candidateId", 16),
                                          POOL.format(n=10000)))
def q_candidates_by_embedding(spark, d):
    """S3: vector recall from the 10000 best-rated items for every item with
    a vector."""
    it = items(spark, d)
    r = C.candidates_by_embedding(it.select("movieId"), it, T.item_vectors(spark, d), size=16, pool=10000)
    return r.select("seedId", "candidateId", "score", "rank")


@register("recommend_default", _sql("""
SELECT u.userId, p.movieId, CAST((SELECT count(*) FROM pool) - (p.prank - 1) AS DOUBLE) AS score, p.prank AS rank
FROM (SELECT DISTINCT userId FROM ratings) u, pool p WHERE p.prank <= 32""", POOL.format(n=800)))
def q_recommend_default(spark, d):
    """For-you list from the 800 best-rated items, 32 per user."""
    r = T.ratings(spark, d)
    return C.recommend_for_users(r, items(spark, d), size=32, model="default", pool=800)


@register("recommend_emb", _sql(_ranked(f"""(
  SELECT u.userId, p.movieId, {cosine_sql('uv.emb', 'iv.emb')} AS score
  FROM (SELECT DISTINCT userId FROM ratings) u LEFT JOIN user_vectors uv USING (userId),
       pool p LEFT JOIN item_vectors iv ON iv.movieId = p.movieId)""", "userId", "movieId", 32),
                                POOL.format(n=800)))
def q_recommend_emb(spark, d):
    """For-you list by user-item vector cosine over the 800-item pool."""
    r = T.ratings(spark, d)
    out = C.recommend_for_users(r, items(spark, d), size=32, model="emb", pool=800,
                                user_vectors=T.user_vectors(spark, d), item_vectors=T.item_vectors(spark, d))
    return out.select("userId", "movieId", "score", "rank")
