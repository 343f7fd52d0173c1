"""Readers, writers and the feature store on hand fixtures."""

import os
import tempfile

from pyspark.sql import functions as F

from cinerank.sources import files as IO
from cinerank.sources import store as ST


def _write(text: str) -> str:
    d = tempfile.mkdtemp(prefix="cinerank-io-")
    p = os.path.join(d, "f.csv")
    with open(p, "w") as fh:
        fh.write(text)
    return p


def test_quoted_title_kept_unless_strict(spark):
    p = _write('movieId,title,genres\n11,"American President, The (1995)",Comedy|Drama\n12,Heat (1995),Action\n')
    lenient = {r.movieId: r.title for r in IO.read_movies(spark, p).collect()}
    assert lenient == {11: "American President, The (1995)", 12: "Heat (1995)"}
    strict = {r.movieId for r in IO.read_movies(spark, p, strict_columns=True).collect()}
    assert strict == {12}


def test_empty_tmdb_id_is_null_unless_strict(spark):
    p = _write("movieId,imdbId,tmdbId\n142,0094878,\n143,0094879,77\n")
    lenient = {r.movieId: r.tmdbId for r in IO.read_links(spark, p).collect()}
    assert lenient == {142: None, 143: "77"}
    assert [r.movieId for r in IO.read_links(spark, p, strict_columns=True).collect()] == [143]


def test_embedding_lines_parse_and_skip_bad(spark):
    d = tempfile.mkdtemp(prefix="cinerank-emb-")
    p = os.path.join(d, "e.txt")
    with open(p, "w") as fh:
        fh.write("1:0.5 0.25 -1.0\nbad line\n2:1 2\nx:1 2\n3:1:2\n")
    got = {r.movieId: list(r.emb) for r in IO.read_embeddings(spark, p).collect()}
    assert got == {1: [0.5, 0.25, -1.0], 2: [1.0, 2.0]}


def test_store_upsert_expiry_and_lookup(spark):
    base = tempfile.mkdtemp(prefix="cinerank-store-")
    st = ST.FeatureStore(spark, os.path.join(base, "s"))
    df = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "userId long, g string, n long")
    ST.put_user_features(st, df, ["g", "n"], F.timestamp_seconds(F.lit(1000)))
    df2 = spark.createDataFrame([(2, "c", 21)], "userId long, g string, n long")
    v = ST.put_user_features(st, df2, ["g", "n"], F.timestamp_seconds(F.lit(500)))
    assert v == 1  # one key lies in one part
    live = {r.id: dict(r.fields) for r in st.get("uf:", F.timestamp_seconds(F.lit(600))).collect()}
    assert live == {"1": {"g": "a", "n": "10"}}  # user 2's new record expired at 500
    allr = {r.id: dict(r.fields) for r in st.get("uf:", F.timestamp_seconds(F.lit(0))).collect()}
    assert allr["2"] == {"g": "c", "n": "21"}
    look = {r.userId: r.fields for r in st.lookup(spark.createDataFrame([(1,), (9,)], "userId long"), "uf:", "userId",
                                                  F.timestamp_seconds(F.lit(600))).collect()}
    assert look[9] is None and dict(look[1]) == {"g": "a", "n": "10"}


def test_a_put_rewrites_only_its_parts(spark):
    base = os.path.join(tempfile.mkdtemp(prefix="cinerank-store-"), "s")
    st = ST.FeatureStore(spark, base, parts=8)
    exp = F.timestamp_seconds(F.lit(1000))
    put = lambda rows: st.put(ST.keyed(spark.createDataFrame(rows, "userId long, g string"), "uf:", "userId", ["g"], exp))
    files = lambda: {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(base) for f in fs
                     if f.endswith(".parquet") and "staging" not in d}
    assert put([(i, "a") for i in range(100)]) == 8
    before = files()
    os.makedirs(os.path.join(base, ".spark-staging-dead", "part=1"))  # what a killed write leaves
    assert put([(2, "c")]) == 1 and put([]) == 0
    after = files()
    gone = {f.split("part=")[1][0] for f in before if f not in after}
    assert len(gone) == 1 and all(after[f] == t for f, t in before.items() if f in after)
    assert {r.key: r.fields["g"] for r in st.current().collect()} == {f"uf:{i}": "c" if i == 2 else "a" for i in range(100)}


def test_two_puts_at_once_to_different_parts(spark):
    import threading
    base = os.path.join(tempfile.mkdtemp(prefix="cinerank-store-"), "s")
    st = ST.FeatureStore(spark, base, parts=8)
    exp = F.timestamp_seconds(F.lit(1000))
    recs = ST.keyed(spark.createDataFrame([(i, "a") for i in range(60)], "userId long, g string"), "uf:", "userId", ["g"], exp)
    part = F.pmod(F.xxhash64("key"), F.lit(8))
    threads = [threading.Thread(target=st.put, args=(recs.where(c),)) for c in (part < 4, part >= 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert st.current().select("key").distinct().count() == 60 == st.current().count()


def test_lookup_misses_expired_records(spark):
    st = ST.FeatureStore(spark, os.path.join(tempfile.mkdtemp(prefix="cinerank-store-"), "s"))
    df = spark.createDataFrame([(1, "a")], "userId long, g string")
    ST.put_user_features(st, df, ["g"], F.timestamp_seconds(F.lit(1000)))
    ids = df.select("userId")
    assert st.lookup(ids, "uf:", "userId", F.timestamp_seconds(F.lit(999))).first().fields == {"g": "a"}
    assert st.lookup(ids, "uf:", "userId", F.timestamp_seconds(F.lit(1000))).first().fields is None
    assert st.lookup(ids, "uf:", "userId").first().fields is None  # expired in 1970


def test_malformed_csv_rows_are_the_same_for_every_projection(spark):
    p = _write("userId,movieId,rating,timestamp\n1,2,3.5,100\n1,x,3.5,100\n1,2,3.5,when\n")
    r = IO.read_ratings(spark, p)
    assert r.count() == len(r.collect()) == len(r.select("userId", "rating").collect()) == len(r.select("timestamp").collect()) == 1
    assert {x.line for x in IO.csv_rejects(spark, p, IO.RATINGS_SCHEMA).collect()} == {"1,x,3.5,100", "1,2,3.5,when"}


def test_bad_number_in_a_vector_file(spark):
    p = _write("1:0.5 oops\n2:1 2\nx:1\n")
    assert [(r.movieId, list(r.emb)) for r in IO.read_embeddings(spark, p).collect()] == [(2, [1.0, 2.0])]
    assert {r.line for r in IO.embedding_rejects(spark, p).collect()} == {"1:0.5 oops", "x:1"}


def test_features_of_items_read_the_ratings_once(spark, monkeypatch):
    from cinerank.plans import q_io
    from cinerank.sources import tables as T
    asked = []
    real = T.ratings
    monkeypatch.setattr(T, "ratings", lambda *a: asked.append(1) or real(*a))
    plan = q_io.q_items_with_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert len(asked) == 1 and "l_quantity" not in plan.replace("#", " ").split("Relation")[0] and "o_custkey" not in plan
