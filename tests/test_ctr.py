"""Click-model data work on hand fixtures."""

import math

import pytest

from cinerank.operators import ctr as M

# The genre vocabulary of the reference models, in its order.
REFERENCE_GENRES = ["Film-Noir", "Action", "Adventure", "Horror", "Romance", "War", "Comedy", "Western",
                    "Documentary", "Sci-Fi", "Drama", "Thriller", "Crime", "Fantasy", "Animation", "IMAX",
                    "Mystery", "Children", "Musical"]


def test_interest_vector_sums_slots_and_skips_missing(spark):
    vec = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 0.0]), (9, [1.0, 1.0])], "movieId long, emb array<float>")
    rows = [(7, 9, 1, 2, None, 5, None)]  # slot 4 has an item without a vector, slots 3 and 5 are empty
    s = spark.createDataFrame(rows, "userId long, movieId long, userRatedMovie1 long, userRatedMovie2 long, "
                                    "userRatedMovie3 long, userRatedMovie4 long, userRatedMovie5 long")
    out = M.interest_vector(s, vec, ["userId", "movieId"]).first()
    c = [1.0, 1.0]
    hs = [[1.0, 2.0], [3.0, 0.0]]
    expect = [sum(h[i] - c[i] for h in hs) for i in range(2)] + [sum(h[i] for h in hs) for i in range(2)] \
        + [2 * c[i] for i in range(2)] + [sum(h[i] * c[i] for h in hs) for i in range(2)]
    assert out.nSlots == 2 and list(out.interest) == pytest.approx(expect)
    w = M.interest_vector(s, vec, ["userId", "movieId"], weighted=True).first()
    assert w.nSlots == 2 and len(w.interest) == 8


def test_candidate_without_vector_gives_null(spark):
    vec = spark.createDataFrame([(1, [1.0, 2.0])], "movieId long, emb array<float>")
    s = spark.createDataFrame([(7, 5, 1, None, None, None, None)],
                              "userId long, movieId long, userRatedMovie1 long, userRatedMovie2 long, "
                              "userRatedMovie3 long, userRatedMovie4 long, userRatedMovie5 long")
    assert M.interest_vector(s, vec, ["userId", "movieId"]).first().interest is None


def test_vocab_and_identity_encoding(spark):
    df = spark.createDataFrame([("War", 5), ("Nope", 2000), (None, -1)], "g string, id long")
    out = M.encode_identity(M.encode_vocab(df, ["g"], REFERENCE_GENRES), "id", 1001).collect()
    assert [r.gIdx for r in out] == [5, -1, -1]
    assert [r.idIdx for r in out] == [5, None, None]
    whole = M.encode_identity(df.filter("id >= 0"), "id", M.id_range(df, "id")).collect()
    assert [r.idIdx for r in whole] == [5, 2000]  # a range from the data leaves no id out


def test_missing_genre_has_its_own_code(spark):
    movies = spark.createDataFrame([(1, "B|A"), (2, "C||B"), (3, " "), (4, None)], "movieId long, genres string")
    df = spark.createDataFrame([("A",), ("C",), (None,), ("Z",)], "g string")
    out = M.genre_codes(df, ["g"], M.genre_vocabulary(movies)).collect()
    assert [r.gIdx for r in out] == [1, 3, 0, 0]  # the first genre is not the missing one


def test_binary_metrics_perfect_ranking(spark):
    df = spark.createDataFrame([(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)], "label int, score double")
    m = M.binary_metrics(df).first()
    assert m.rocAuc == pytest.approx(1.0) and m.prAuc == pytest.approx(1.0) and m.accuracy == 1.0
    # positives contribute -ln(p), negatives -ln(1 - p)
    assert m.logLoss == pytest.approx(-(math.log(0.9) + math.log(0.8) + math.log(0.8) + math.log(0.9)) / 4)


@pytest.fixture(scope="module")
def ratings(spark):
    rows = [(u * 10**11, i, 1 if (u + i) % 3 else 0) for u in range(30) for i in range(20)]
    return spark.createDataFrame(rows, "userId long, movieId long, label int")


def test_factors_cover_all_train_ids_of_any_size(spark, ratings):
    f = M.id_factors(ratings, rank=3)
    assert {r.userId for r in f.users.collect()} == {u * 10**11 for u in range(30)}
    assert {r.movieId for r in f.items.collect()} == set(range(20))
    assert all(len(r.uf) == 3 for r in f.users.collect())


@pytest.mark.parametrize("head", ["dot", "mlp"])
def test_pair_model_learns_and_scores_unknown_ids(spark, ratings, head):
    m, f = M.pair_model(ratings, head, max_iter=100)
    rows = ratings.unionByName(spark.createDataFrame([(7, 999, 1)], ratings.schema))
    got = M.predict(m, M.with_factors(rows, f)).collect()
    assert len(got) == 601 and all(0 <= r.score <= 1 for r in got)
    known = [r for r in got if r.userId != 7]
    assert sum((r.score >= 0.5) == (r.label == 1) for r in known) / len(known) > 0.8


def test_model_round_trip(spark, ratings, tmp_path):
    m, f = M.pair_model(ratings)
    M.save_model(m, f, str(tmp_path))
    m2, f2 = M.load_model(spark, str(tmp_path))
    a = {(r.userId, r.movieId): r.score for r in M.predict(m, M.with_factors(ratings, f)).collect()}
    b = {(r.userId, r.movieId): r.score for r in M.predict(m2, M.with_factors(ratings, f2)).collect()}
    assert a == b


def test_indicators_of_many_ids_name_no_slots(spark):
    """the driver held a name for each slot of an id's vector, in the fitted model and in the column's metadata."""
    df = spark.createDataFrame([(0,), (7_000_000,), (8_000_000,), (None,)], "code int")
    out = M.indicator(df, ["code"], spark.createDataFrame([(7_000_000,)], "code int"))
    assert out.schema["codeVec"].metadata["ml_attr"] == {"num_attrs": 7_000_002}
    got = {r.code: r.codeVec for r in out.collect()}
    assert got.pop(None) is None
    assert {c: (v.size, list(v.indices), list(v.values)) for c, v in got.items()} == {
        c: (7_000_002, [min(c, 7_000_001)], [1.0]) for c in (0, 7_000_000, 8_000_000)}
    small = M.indicator(df.where("code = 0"), ["code"])
    assert small.first().codeVec.size == 2 and M._vector_width(small, "codeVec") == 2
    with pytest.raises(Exception, match="negative"):
        M.indicator(spark.createDataFrame([(-1,), (3,)], "code int"), ["code"]).collect()
