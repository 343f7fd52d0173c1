"""Candidate recall and ranking for items and users (S1-S3, J8-J10, V3-V5,
T4, R1-R5), in batch: seeds and users are tables, not single requests.

Recall lists that are the same for every seed (global top-N by rating or
year) have a size fixed by a parameter; they are aggregated to one bounded
array, which a scalar subquery attaches to each seed. Per-genre lists are one
bounded array per genre and join on the genre key; adaptive execution picks the
join by their bytes at run time and splits a hot genre.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinerank.functions.columns import blend_score, cosine, genre_array, genre_similarity, sq_norm
from cinerank.operators.ranking import top_items, top_items_by_genre, top_k
from cinerank.operators.vectors import pool_top_k


def bounded_list(df: DataFrame, *cols: str) -> Column:
    """The rows of a result whose size is a parameter (a top-N list) as one
    array, attached where it is used by a scalar subquery."""
    row = F.struct(*cols) if len(cols) > 1 else F.col(cols[0])
    return F.lit(df.agg(F.collect_list(row).alias("l")).scalar())


def _genre_lists(items: DataFrame, per_genre: int, vectors: DataFrame | None = None) -> DataFrame:
    g = top_items_by_genre(items, per_genre, "rating").select(
        "genre", F.col("movieId").alias("candidateId"),
        genre_array("genres").alias("candGenres"), F.col("averageRating").alias("candAvg"))
    if vectors is not None:
        g = g.join(vectors.select(F.col("movieId").alias("candidateId"), F.col("emb").alias("candEmb")),
                   "candidateId", "left")
    return g


def _seed_rows(seeds: DataFrame, items: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    s = items.join(seeds.select("movieId"), "movieId", "left_semi").select(
        F.col("movieId").alias("seedId"), genre_array("genres").alias("seedGenres"))
    if vectors is not None:
        s = s.join(vectors.select(F.col("movieId").alias("seedId"), F.col("emb").alias("seedEmb")), "seedId", "left")
    return s


def candidates_by_genre(seeds: DataFrame, items: DataFrame, per_genre: int = 100) -> DataFrame:
    """S1 + J8 + J10: union over the seed's genres of each genre's `per_genre`
    best-rated items, without the seed itself. One row per (seed, candidate)
    pair matched by genre (duplicates when several genres match)."""
    s = _seed_rows(seeds, items)
    s = s.select("*", F.explode("seedGenres").alias("genre"))
    c = s.join(_genre_lists(items, per_genre), "genre")
    return c.filter(F.col("candidateId") != F.col("seedId")).drop("genre")


def candidate_ids(seeds: DataFrame, items: DataFrame, per_genre: int = 100, more: Column | None = None) -> DataFrame:
    """(seedId, candidateId) of S1 without repeats: the id lists of a seed's few
    genres meet in one row, are united there (with the ids in `more`) and
    exploded once."""
    s = _seed_rows(seeds, items)
    lists = top_items_by_genre(items, per_genre, "rating").groupBy("genre").agg(F.collect_list("movieId").alias("ids"))
    by_genre = s.select("seedId", F.explode("seedGenres").alias("genre")).join(lists, "genre")
    found = by_genre.groupBy("seedId").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    if more is not None:
        found = s.select("seedId").join(found, "seedId", "left").select(
            "seedId", F.concat(F.coalesce("ids", F.array().cast("array<bigint>")), more).alias("ids"))
    return (found.select("seedId", F.explode(F.array_distinct("ids")).alias("candidateId"))
            .filter(F.col("candidateId") != F.col("seedId")))


def similar_items(seeds: DataFrame, items: DataFrame, size: int = 16, model: str = "default",
                  vectors: DataFrame | None = None, per_genre: int = 100) -> DataFrame:
    """The `size` best genre candidates of each seed (T4: score
    descending, id ascending). Item ids are unique.
    default: 0.7 * genre overlap + 0.3 * average/5; emb: cosine of vectors
    (-1 when either is missing)."""
    if model == "emb":
        found = _by_vector(seeds, items, vectors, size, per_genre)
    else:
        found = _by_genre_set(seeds, items, size, per_genre)
    return found.select("seedId", F.posexplode("best").alias("at", "c")).select(
        "seedId", F.bitwise_not("c.last").alias("candidateId"), "c.score", (F.col("at") + 1).cast("long").alias("rank"))


def _place(score: Column, candidate: Column) -> Column:
    """A struct that sorts descending into the ranking's order."""
    return F.struct(score.alias("score"), F.bitwise_not(candidate).alias("last"))


def _by_genre_set(seeds: DataFrame, items: DataFrame, size: int, per_genre: int) -> DataFrame:
    """(seedId, best): the blended score depends on the seed's list of genres
    alone, so each list that occurs is ranked once, one place deeper than
    asked for, and its seeds take the ranking without themselves."""
    s = _seed_rows(seeds, items)
    pairs = s.select("seedGenres").distinct().select("seedGenres", F.explode("seedGenres").alias("genre")).join(
        _genre_lists(items, per_genre), "genre")
    score = blend_score(genre_similarity("seedGenres", "candGenres"), "candAvg")
    scored = pairs.select("seedGenres", _place(score, F.col("candidateId")).alias("c"))
    # a candidate met by several genres has one rank, so the partial group limit still applies
    w = Window.partitionBy("seedGenres").orderBy(F.col("c").desc())
    best = (scored.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= size + 1)
            .groupBy("seedGenres").agg(F.sort_array(F.collect_set("c"), asc=False).alias("best")))
    others = F.filter("best", lambda c: c["last"] != F.bitwise_not(F.col("seedId")))
    return s.join(best, "seedGenres").select("seedId", F.slice(others, 1, size).alias("best"))


def _by_vector(seeds: DataFrame, items: DataFrame, vectors: DataFrame, size: int, per_genre: int) -> DataFrame:
    """(seedId, best): a seed meets each of its genres' lists as one row, which
    is scored and cut to `size` where they meet; only ids and scores travel on."""
    lists = _genre_lists(items, per_genre, vectors).groupBy("genre").agg(
        F.collect_list(F.struct("candidateId", "candEmb", sq_norm("candEmb").alias("norm"))).alias("list"))
    s = _seed_rows(seeds, items, vectors).withColumn("norm", sq_norm("seedEmb"))
    met = s.select("seedId", "seedEmb", "norm", F.explode("seedGenres").alias("genre")).join(lists, "genre")
    scored = F.transform(F.filter("list", lambda c: c["candidateId"] != F.col("seedId")), lambda c: _place(
        cosine(F.col("seedEmb"), c["candEmb"], F.col("norm"), c["norm"]), c["candidateId"]))
    cut = met.select("seedId", F.slice(F.sort_array(scored, asc=False), 1, size).alias("best"))
    return cut.groupBy("seedId").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("best"))), asc=False),
                                             1, size).alias("best"))


def candidates_multi(seeds: DataFrame, items: DataFrame, per_genre: int = 20, by_rating: int = 100,
                     by_year: int = 100) -> DataFrame:
    """Genre top `per_genre` U global top `by_rating` by rating U global
    top `by_year` by release year, de-duplicated, without the seed."""
    both = top_items(items, by_rating, "rating").select("movieId").union(
        top_items(items, by_year, "releaseYear").select("movieId"))
    return candidate_ids(seeds, items, per_genre, bounded_list(both, "movieId"))


def candidates_by_embedding(seeds: DataFrame, items: DataFrame, vectors: DataFrame, size: int = 16,
                            pool: int = 10000) -> DataFrame:
    """S3: cosine of each seed's vector to the `pool` best-rated items (the
    seed itself may be among them), best `size`; seeds without a vector give
    no rows; pool items without a vector score -1."""
    pool_items = top_items(items, pool, "rating").select("movieId")
    pool_vecs = pool_items.join(vectors, "movieId", "left")
    q = vectors.join(seeds.select("movieId"), "movieId", "left_semi")
    r = pool_top_k(q, "movieId", "emb", pool_vecs, "movieId", "emb", size, "cosine")
    return r.select(F.col("qid").alias("seedId"), F.col("cid").alias("candidateId"), "score", "rank")


def recommend_for_users(users: DataFrame, items: DataFrame, size: int = 32, model: str = "default",
                        pool: int = 800, user_vectors: DataFrame | None = None,
                        item_vectors: DataFrame | None = None, scores: DataFrame | None = None) -> DataFrame:
    """Rank the `pool` best-rated items for every user.
    default: score = pool size - position (the rating order itself);
    emb: cosine(user vector, item vector), -1 when either is missing;
    scores: a given (userId, movieId, score) table, e.g. model output."""
    pool_items = top_items(items, pool, "rating").select("movieId", F.col("rank").alias("poolRank"))
    u = users.select("userId").distinct()
    if model == "emb":
        pv = pool_items.join(item_vectors, "movieId", "left")
        uv = u.join(user_vectors, "userId", "left")
        r = pool_top_k(uv, "userId", "emb", pv, "movieId", "emb", size, "cosine")
        return r.select(F.col("qid").alias("userId"), F.col("cid").alias("movieId"), "score", "rank")
    if model == "scores":
        s = scores.join(u, "userId", "left_semi").join(pool_items.select("movieId"), "movieId", "left_semi")
        return top_k(s, ["userId"], [F.col("score").desc(), F.col("movieId").asc()], size) \
            .select("userId", "movieId", "score", "rank")
    # default: the pool order itself, identical for every user
    n = pool_items.agg(F.count(F.lit(1))).scalar()
    head = bounded_list(pool_items.filter(F.col("poolRank") <= size), "movieId", "poolRank")
    return u.select("userId", F.explode(head).alias("r")).select(
        "userId", "r.movieId", (n - F.col("r.poolRank") + 1).cast("double").alias("score"), F.col("r.poolRank").alias("rank"))


def recommend_by_model(users: DataFrame, items: DataFrame, score: Callable[[DataFrame], DataFrame], size: int = 32,
                       pool: int = 800) -> DataFrame:
    """R5 with any fitted model: every user meets the `pool` best-rated items,
    `score` adds a column `score` to these (userId, movieId) rows, each user's
    best `size` stay (score desc, movieId asc). The pool's size is a parameter, so
    rows grow with the users alone; a user's rows are made where the user is, and
    scored and ranked there. A score with a method `best` (users, pool, size) ranks
    the pool itself (`click_models.PairScorer`: block by block)."""
    chosen = top_items(items, pool, "rating").select("movieId")
    if hasattr(score, "best"):
        return score.best(users.select("userId").distinct(), chosen, size).select("userId", "movieId", "score", "rank")
    ids = bounded_list(chosen, "movieId")
    pairs = users.select("userId").distinct().select("userId", F.explode(ids).alias("movieId"))
    return top_k(score(pairs), ["userId"], [F.col("score").desc(), F.col("movieId").asc()], size) \
        .select("userId", "movieId", "score", "rank")
