"""Decision-log fixtures: each test pins one semantic choice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinerank.functions.columns import add_ranked_genres, blend_score, clean_title, genre_similarity, release_year
from cinerank.operators import candidates as C
from cinerank.operators import graph as G
from cinerank.operators import profiles as P
from cinerank.operators import ranking as R
from cinerank.operators import samples as S
from cinerank.sources import tables as T

from conftest import SF


def test_release_year_and_title(spark):
    rows = [("Toy (1995)",), (" Toy (1995) ",), ("abc",), (None,), ("Babylon 5 show",)]
    df = spark.createDataFrame(rows, "t string")
    out = df.select(release_year("t").alias("y"), release_year("t", 0).alias("y0"), clean_title("t").alias("c")).collect()
    assert [r.y for r in out] == [1995, 1995, 1990, 1990, 1990]
    assert [r.y0 for r in out] == [1995, 1995, 0, 0, 0]
    assert [r.c for r in out] == ["Toy", "Toy", "abc", None, "Babylon 5 show"]


def test_genre_rank_ties_by_name(spark):
    df = spark.createDataFrame([(["Drama|War", "War", "Crime"],), ([],)], "g array<string>")
    out = add_ranked_genres(df, "g", "r").collect()
    assert out[0].r == ["War", "Crime", "Drama"] and out[1].r == []


def test_one_rating_stats(spark):
    r = spark.createDataFrame([(1, 7, 4.0, 1)], "userId long, movieId long, rating double, timestamp long")
    st = P.rating_stats(r).first()
    assert st.ratingCount == 1 and st.ratingVar is None
    assert S.item_rating_features(r).first().movieRatingStddev == "0.00"


def test_time_order_is_numeric(spark):
    r = spark.createDataFrame([(1, 10, 4.0, 1000000000), (1, 11, 4.0, 999999999)],
                              "userId long, movieId long, rating double, timestamp long")
    seq = G.user_sequences(r, ["timestamp", "movieId"]).first()
    assert seq.items == ["11", "10"]


def test_top_ratings_tie_keeps_earliest(spark):
    rows = [(u, 5, 4.0, 100 + u) for u in range(11)]
    r = spark.createDataFrame(rows, "userId long, movieId long, rating double, timestamp long")
    m = spark.createDataFrame([(5, "x (2000)", "A")], "movieId long, title string, genres string")
    got = sorted(x.userId for x in P.top_ratings(r, m, ["timestamp"], 10).collect())
    assert got == list(range(10))  # the newest equal score is the one left out


def test_user_profile_clamps(spark):
    r = spark.createDataFrame([(1, 1, 0.5, 1), (1, 2, 5.0, 2)], "userId long, movieId long, rating double, timestamp long")
    u = P.user_profiles(r).first()
    assert (u.highestRating, u.lowestRating, u.ratingCount, u.averageRating) == (5.0, 0.5, 2, 2.75)


def test_genre_score(spark):
    df = spark.createDataFrame([(["A", "B"], ["B", "C", "D"], 4.0), ([], [], 5.0)],
                               "a array<string>, b array<string>, avg double")
    out = df.select(genre_similarity("a", "b").alias("g"), blend_score(genre_similarity("a", "b"), "avg").alias("s")).collect()
    assert out[0].g == pytest.approx(0.1) and out[0].s == pytest.approx(0.1 * 0.7 + 0.3 * 0.8)
    assert out[1].g == 0.0


def test_similar_items_exclude_seed_and_unknown_seed(spark):
    items = spark.createDataFrame([(1, "A|B", 4.0), (2, "B", 3.0), (3, "C", 5.0)],
                                  "movieId long, genres string, averageRating double")
    seeds = spark.createDataFrame([(1,), (99,)], "movieId long")
    out = C.similar_items(seeds, items, size=5).collect()
    assert {(r.seedId, r.candidateId) for r in out} == {(1, 2)}


def test_same_answer_under_different_partitioning(spark):
    r, m = T.ratings(spark, SF), T.movies(spark, SF)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        a = S.training_samples(r, m, T.RATING_ORDER).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        b = S.training_samples(r, m, T.RATING_ORDER).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_split_parts_disjoint_and_cover(spark):
    r = T.ratings(spark, SF)
    key = ["userId", "movieId", "timestamp"] + T.TIE_BREAK
    sp = S.split_samples(r, key, fraction=0.5, seed=3)
    parts = {row.part for row in sp.select("part").distinct().collect()}
    assert parts == {"train", "test"}
    sampled = sp.count()
    assert sp.select(*key).distinct().count() == sampled
    assert 0.4 * r.count() < sampled < 0.6 * r.count()


def test_candidate_ids_are_the_distinct_genre_pairs(spark):
    r, m, l = T.ratings(spark, SF), T.movies(spark, SF), T.links(spark, SF)
    items = P.item_profiles(m, l, r)
    seeds = items.select("movieId")
    a = C.candidates_by_genre(seeds, items, 20).select("seedId", "candidateId").distinct()
    b = C.candidate_ids(seeds, items, 20).select("seedId", "candidateId")
    assert a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0


def test_blank_genres_have_no_shelf(spark):
    items = spark.createDataFrame([(1, "A||B", 4.0, 2000), (2, "", 3.0, 2001), (3, None, 5.0, 2002), (4, " ", 5.0, 2002)],
                                  "movieId long, genres string, averageRating double, releaseYear int")
    assert {x.genre for x in R.genre_items(items).collect()} == {"A", "B"}
    shelf = R.top_items_by_genre(items, 5, genres=spark.createDataFrame([("B",), ("Z",)], "genre string")).collect()
    assert [(x.genre, x.movieId) for x in shelf] == [("B", 1)]


def test_latest_features_are_those_of_the_newest_sample(spark):
    r, m = T.ratings(spark, SF), T.movies(spark, SF)
    s = S.training_samples(r, m, T.RATING_ORDER)
    for key, cols, got in (("userId", S.USER_FEATURES, S.latest_user_features(r, m, T.RATING_ORDER)),
                           ("movieId", S.ITEM_FEATURES, S.latest_item_features(r, m, T.RATING_ORDER))):
        newest = s.groupBy(key).agg(F.max_by(F.struct(*cols), F.struct(*T.RATING_ORDER)).alias("x")).select(key, "x.*")
        want = newest.na.fill("", subset=[c for c, t in newest.dtypes if t == "string"])
        assert sorted(map(str, got.select(key, *cols).collect())) == sorted(map(str, want.collect()))


def test_load_counts_with_unknown_and_missing_ids(spark):
    r = spark.createDataFrame([(1, 5), (2, 5), (1, 9), (3, None)], "userId long, movieId long")
    m = spark.createDataFrame([(5,), (6,)], "movieId long")
    l = spark.createDataFrame([(5,), (7,)], "movieId long")
    assert {x.source: x.rows for x in P.load_counts(r, m, l).collect()} == {
        "movies": 2, "links_matched": 1, "ratings": 4, "ratings_matched": 2, "users": 3}


def test_cluster_sessions_must_name_the_shared_folder(spark):
    from types import SimpleNamespace

    from cinerank import session
    unset = SimpleNamespace(isEmpty=lambda: True)
    sc = SimpleNamespace(master="spark://host:7077", getConf=lambda: {}, applicationId="a",
                         _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(SimpleNamespace(sparkContext=sc, conf={}))


@pytest.mark.parametrize("model", ["default", "emb"])
def test_similar_items_are_the_best_of_all_genre_candidates(spark, model):
    """Against every (seed, candidate) pair scored one by one."""
    r, m, l = T.ratings(spark, SF), T.movies(spark, SF), T.links(spark, SF)
    items = P.item_profiles(m, l, r).select("movieId", "genres", "averageRating", "releaseYear").cache()
    vectors = spark.createDataFrame(  # missing, null, zero, shorter and equal vectors
        [(x.movieId, [[1.0, 0.0], None, [0.0, 0.0], [2.0], [x.movieId / 7, 1.0]][x.movieId % 6]) for x in items.collect()
         if x.movieId % 6 < 5], "movieId long, emb array<float>")
    rows = {x.movieId: x for x in items.collect()}
    emb = {x.movieId: x.emb for x in vectors.collect()}
    shelf = {}
    for i in sorted(rows, key=lambda i: (-rows[i].averageRating, i)):
        for g in {g for g in (rows[i].genres or "").split("|") if g.strip()}:
            shelf.setdefault(g, []).append(i)

    def score(a, b):
        if model == "default":
            x, y = rows[a].genres.split("|"), rows[b].genres.split("|")
            return sum(g in y for g in x) / (len(x) + len(y)) / 2 * 0.7 + 0.3 * (rows[b].averageRating / 5)
        x, y = emb.get(a), emb.get(b)
        if not x or not y or len(x) != len(y) or not any(x) or not any(y):
            return -1.0
        f = np.float32
        dot = lambda p, q: sum(float(f(u) * f(v)) for u, v in zip(p, q))
        return dot(x, y) / (dot(x, x) ** 0.5 * dot(y, y) ** 0.5)

    want = set()
    for i in rows:
        near = {c for g in (rows[i].genres or "").split("|") for c in shelf.get(g, [])[:20]} - {i}
        best = sorted(((-score(i, c), c) for c in near))[:6]
        want |= {(i, c, k + 1, round(-s, 9)) for k, (s, c) in enumerate(best)}
    got = C.similar_items(items.select("movieId"), items, 6, model, vectors, per_genre=20).collect()
    assert {(x.seedId, x.candidateId, x["rank"], round(x.score, 9)) for x in got} == want
    assert len(got) == len(want) > 100
    items.unpersist()


def test_written_samples_are_counted_by_their_own_job(spark, tmp_path):
    from cinerank.sources import files
    split = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test"), (None, "train")], "userId long, part string")
    assert files.write_samples(split, str(tmp_path / "s")) == {"train": 3, "test": 1}
    assert files.write_samples(split.limit(0), str(tmp_path / "e")) == {"train": 0, "test": 0}
