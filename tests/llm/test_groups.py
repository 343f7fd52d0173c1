"""Operators on groups of rows: exact and near duplicates of texts and vectors,
host reputation, shared helpers; each against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cinerank.llm import block_naming, bottomk_dedup, common, host_reputation, projection_dedup, queries


def components(n, pairs):
    lab = list(range(n))
    for a, b in pairs:
        x, y = lab[a], lab[b]
        if x != y:
            lab = [min(x, y) if v in (x, y) else v for v in lab]
    return lab


# --- helpers -------------------------------------------------------------------

def test_connected_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 480)] + [
        (500, i) for i in range(501, 700)]
    got = {x.node: x.comp for x in common.connected_components(spark.createDataFrame(pairs, "a long, b long"), "t").collect()}
    want = components(700, pairs)
    assert got == {i: want[i] for i in got} and set(got) == {x for p in pairs if p[0] != p[1] for x in p}
    none = common.connected_components(spark.createDataFrame([], "a long, b long"), "t")
    assert none.count() == 0


def test_key_groups_across_batches():
    import pandas as pd
    rows = [(k, i) for i, k in enumerate("aabbbcddddde")]
    batches = [pd.DataFrame(rows[i:i + 3], columns=["k", "v"]) for i in range(0, 12, 3)] + [pd.DataFrame({"k": [], "v": []})]
    got = [(g["k"].iat[0], g["v"].tolist()) for g in common.key_groups(iter(batches), ["k"])]
    assert [(k, len(v)) for k, v in got] == [("a", 2), ("b", 3), ("c", 1), ("d", 5), ("e", 1)]


def test_added_columns_keep_nullable_numbers(spark):
    df = spark.createDataFrame([(2**60 + 1, "a"), (None, None)], "Id long, text string").withColumn("OUT", F.lit(1))
    got = common.add_columns(df, lambda: lambda t: ([len(x or "") for x in t],), ["text"], {"out": "long"})
    assert got.columns == ["Id", "text", "out"]
    assert {(r.Id, r.out) for r in got.collect()} == {(2**60 + 1, 1), (None, 0)}


# --- exact groups ----------------------------------------------------------------

def _exact_by_hand(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    groups = {}
    for (i, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(i)
    return sorted((str(i), str(min((x for x in groups[t] if x is not None), default=None)), len(groups[t]),
                   hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm))


TEXTS = ["", None, " ", "\t\n", "a b", "a  b", "a\r\nb", "a\u00a0b", "x" * 50, "x" * 49, "x" * 48 + "y", "é" * 33, "ab" * 100, "ab" * 100,
         "ab" * 99 + "ba", "long " * 60, "long " * 60 + "."]


@pytest.mark.parametrize("digest", [F.xxhash64, lambda b: F.xxhash64(b) % 3])
def test_exact_groups(spark, digest):
    rows = [(i * 7 % 40, t) for i, t in enumerate(TEXTS)] + [(99, "a b"), (99, "a b"), (None, "a b"), (None, "only here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_name", F.lit(1))
    got = block_naming.exact_groups(df, block_bytes=8, digest=digest).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == _exact_by_hand(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(r.text_sha256, []).append(r)
    for g in by_text.values():  # one row of each group stays, and it has the kept id
        assert [r.doc_id for r in g if r.kept] == [g[0].keep_id]


def test_exact_rows_that_stay(spark):
    rows = [(1, "a b"), (1, "a b"), (2, "a  b"), (1, "c"), (None, None), (5, "")]
    kept = block_naming.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, "a b"), (1, "c"), (5, "")]
    assert block_naming.exact_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- near groups of texts ------------------------------------------------------------

def _near_by_hand(rows, size, percent):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        sets.append({tuple(w[i:i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set())
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    lab = components(len(rows), pairs)
    least = {}
    for (i, _), c in zip(rows, lab):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return {k: (rows[k][0], len(sets[k]), least.get(lab[k]) if sets[k] else rows[k][0]) for k in range(len(rows))}


def _mutants(seed, n, words=60):
    """Families of texts with few and many changed words, long and short."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [r.choice(vocab) for _ in range(r.randint(3, words))]
        out.append(" ".join(base))
        for _ in range(r.randint(0, 6)):
            w = list(base)
            for _ in range(r.randint(0, 3)):
                w[r.randrange(len(w))] = r.choice(vocab)
            out.append(" ".join(w + [r.choice(vocab) for _ in range(r.randint(0, 2))]))
    return out


@pytest.mark.parametrize("size, percent, words", [(3, 85, 60), (5, 80, 12), (1, 80, 9), (3, 85, 400)])
def test_near_groups(spark, size, percent, words):
    texts = _mutants(size * 100 + words, 40, words) + ["", None, " \n", "one", "ONE", "one two", "A b C", "a B c", "x " * 300]
    texts += [f"shared passage of words that stands in very many documents number {i} {i * 7}" for i in range(60)]
    rows = [(i * 3 % 1000, t) for i, t in enumerate(texts)] + [(5, texts[0]), (None, texts[0]), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sketch", F.lit(0))
    want = _near_by_hand(rows, size, percent)
    got = bottomk_dedup.near_groups(df, size=size, percent=percent, cell=16).collect()
    assert sorted(str((r.doc_id, r.n_shingles, r.component_id)) for r in got) == sorted(str(w) for w in want.values())
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_rows_that_stay(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(4, t), (2, t), (2, t), (9, "other words entirely here now"), (7, "")]
    kept = bottomk_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [2, 7, 9]
    assert bottomk_dedup.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_rows_that_stay_are_told_apart_by_links_not_ids(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(1, "a b"), (1, "c"), (1, "c"), (None, "d e f"), (None, "unlike words"), (None, None), (5, ""), (5, " "),
            (None, t), (3, t), (None, "seven of " + t), (8, "seven of " + t)]
    kept = bottomk_dedup.keep_first(spark.createDataFrame(rows, "doc_id long, text string"), percent=80).collect()
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept))) == sorted(map(str, [
        (1, "a b"), (1, "c"), (None, "d e f"), (None, "unlike words"), (None, None), (5, ""), (5, " "), (3, t)]))


# --- near groups of vectors -----------------------------------------------------------

def test_near_vectors(spark):
    r = np.random.default_rng(3)
    rows = []
    for g, n in enumerate([1, 2, 5, 90, 40] + [1] * 60):
        c = r.standard_normal(24)
        rows += [(c + 0.12 * r.standard_normal(24) * (g % 2 + 1), g % 3) for _ in range(n)]
    r.shuffle(rows := [(v.tolist(), lab) for v, lab in rows])
    rows += [([0.0] * 24, 0), (None, 0), ([], 0), ([1.0] * 24, None), ([1.0, None] * 12, 0), ([float("nan")] * 24, 1),
             ([1e300] * 24, 2), ([1e-300] * 24, 2), ([2.0, 0.0], 2), ([1.0, 0.0], 2), ([2.0, 0.0], 2)]
    data = [(i * 5 % len(rows), v, lab) for i, (v, lab) in enumerate(rows)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit(0))
    pairs, links = [], [0] * len(data)
    unit = [None if v is None or not v or None in v or not np.isfinite(v).all() or not any(v) else
            np.array(v) / np.abs(v).max() for _, v, _ in data]
    unit = [None if u is None else u / np.sqrt((u * u).sum()) for u in unit]
    for a in range(len(data)):
        for b in range(a):
            if unit[a] is not None and unit[b] is not None and data[a][2] == data[b][2] is not None and len(unit[a]) == len(
                    unit[b]) and unit[a] @ unit[b] >= 0.93:
                pairs.append((a, b))
                links[a] += 1
                links[b] += 1
    lab = components(len(data), pairs)
    least = {c: min(data[i][0] for i in range(len(data)) if lab[i] == c) for c in lab}
    want = {data[i][0]: (links[i], least[lab[i]]) for i in range(len(data))}
    got = {x.vec_id: (x.n_links, x.component_id) for x in projection_dedup.near_vectors(df, window=8, tile=16).collect()}
    assert max(links) > 30 and got == want
    assert projection_dedup.near_vectors(df.limit(0)).count() == 0


def _isolated_pairs(seed, n, pairs, dim=64, at=0.93):
    """n unit vectors in one label; rows 2i and 2i + 1, i < pairs, at cosine `at`."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim))
    x /= np.sqrt((x * x).sum(1))[:, None]
    a, b = x[0:2 * pairs:2], x[1:2 * pairs:2]
    b -= (a * b).sum(1)[:, None] * a
    b /= np.sqrt((b * b).sum(1))[:, None]
    x[1:2 * pairs:2] = (at + 1e-9) * a + np.sqrt(1 - (at + 1e-9) ** 2) * b
    return x


def test_passes_follow_the_rows_of_a_label():
    assert projection_dedup.passes_for(0, 0.93) == projection_dedup.passes_for(24, 0.93) == projection_dedup.LEAST_PASSES
    got = [projection_dedup.passes_for(n, 0.93) for n in (1_000, 20_000, 200_000, 600_000)]
    assert got == sorted(set(got)) and got[0] > 8
    assert projection_dedup.passes_for(20_000, 0.93, miss=1e-6) > got[1] > projection_dedup.passes_for(20_000, 0.97)
    assert projection_dedup.passes_for(20_000, 0.93, window=100) < got[1]


def test_isolated_pairs_at_the_threshold_are_found(spark):
    x = _isolated_pairs(11, 12_000, 300)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.component_id for r in projection_dedup.near_vectors(df).where("n_links > 0").collect()}
    assert {i: got.get(2 * i + 1) for i in range(300)} == {i: 2 * i for i in range(300)}  # eight passes miss some


def test_isolated_pairs_beside_a_common_direction_are_found(spark):
    x = _isolated_pairs(12, 8_000, 300, at=0.86)
    x -= np.outer(x[:, 0], np.eye(64)[0])
    x = np.sqrt(0.5) * x / np.sqrt((x * x).sum(1))[:, None] + np.sqrt(0.5) * np.eye(64)[0]  # unrelated ones at 0.5 on average
    near = [i for i in range(300) if x[2 * i] @ x[2 * i + 1] >= 0.93]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: r.component_id for r in projection_dedup.near_vectors(df).where("n_links > 0").collect()}
    assert len(near) > 100 and sum(got.get(2 * i + 1) == 2 * i for i in near) >= 0.99 * len(near)


def test_packed_vectors_bound_the_cosine():
    import pandas as pd
    r = np.random.default_rng(5)
    u = projection_dedup.unit(r.standard_normal((400, 20)) + 1.5)
    rows = pd.DataFrame({"step": 0, "grp": 7, "vec": [v.tobytes() for v in projection_dedup.packed(u)]})
    i, j, sure = projection_dedup._windowed(rows, 400, 0.7)
    got = dict(zip(zip(i.tolist(), j.tolist()), sure.tolist()))
    want = {(a, b) for a in range(400) for b in range(a + 1, 400) if u[a] @ u[b] >= 0.7}
    assert want <= set(got) and {p for p, s in got.items() if s} <= want
    assert len(got) - sum(got.values()) < 0.1 * 400 * 399 / 2  # few pairs are left in doubt
    rows["grp"] = np.arange(400)
    assert not len(projection_dedup._windowed(rows, 400, 0.7)[0])


# --- host reputation --------------------------------------------------------------

@pytest.mark.parametrize("url, host, path, rule", [
    (None, "", "", None), ("no scheme", "", "", None), ("http://", "", "", None), ("http://A.Example.COM", "a.example.com", "", None),
    ("http://x.com/", "x.com", "/", "com/"), ("http://www.example.com/en/1?q#f", "www.example.com", "/en/1", "www.example.com/en/"),
    ("http://b.www.example.com/en/", "b.www.example.com", "/en/", "www.example.com/en/"),
    ("https://m.example.com/en/x/#y", "m.example.com", "/en/x/", "example.com/en/"), ("http://notexample.com/en/", "notexample.com", "/en/", "com/"),
    ("http://a.net/es/1", "a.net", "/es/1", "net/es/"), ("http://a.net/esx", "a.net", "/esx", None), ("http://a.net?x=/fr/", "a.net", "", None),
    ("x://y://net/fr/", "y:", "//net/fr/", None)])
def test_rules(spark, url, host, path, rule):
    df = spark.createDataFrame([(1, url)], "page_id long, url string")
    r = host_reputation.judge(df, spark.createDataFrame([], "page_id long, bad int"), queries.URL_RULES).first()
    assert (r.host, r.path, r.rule) == (host, path, rule)
    assert r.verdict == (dict((b, a) for a, b in queries.URL_RULES)[rule] if rule else "allow")


def test_reputation_shrinks_small_hosts(spark):
    rows, bad = [], []
    for h, (n, k) in {"big.bad.org": (60, 55), "one.bad.org": (1, 0), "new.bad.org": (0, 0), "a.good.org": (80, 2),
                      "b.good.org": (1, 1), "c.fine.net": (50, 3)}.items():
        for j in range(max(n, 1)):
            rows.append((len(rows), f"http://{h}/{j}"))
            if j < n:
                bad.append((len(rows) - 1, int(j < k)))
    df = spark.createDataFrame(rows + [rows[0]], "page_id long, url string")
    out = spark.createDataFrame(bad + [(None, 1), (3, None)], "page_id long, bad int")
    got = host_reputation.judge(df, out, []).collect()
    verdict = {r.host: r.verdict for r in got}
    assert len(got) == len(rows) + 1
    assert verdict["big.bad.org"] == "block" and verdict["a.good.org"] == verdict["c.fine.net"] == "allow"
    assert verdict["b.good.org"] == "allow"  # one bad page on a good domain is not enough
    post = {r.host: r for r in host_reputation.host_posteriors(
        df.join(out, "page_id", "left").select(host_reputation.url_host(F.col("url")).alias("host"), "bad")).collect()}
    assert post["new.bad.org"].mean > post["b.good.org"].mean * 0.5 and post["one.bad.org"].sd > post["big.bad.org"].sd


@pytest.mark.parametrize("host, domain, suffix", [
    ("a.b.bbc.co.uk", "bbc.co.uk", "co.uk"), ("gov.uk", "gov.uk", "gov.uk"), ("www.tax.gov.uk:443", "tax.gov.uk", "gov.uk"),
    ("x.y.example.com.", "example.com", "com"), ("me@x.example.com:80", "example.com", "com"), ("localhost", "localhost", "localhost"),
    ("10.0.0.1:8080", "10.0.0.1", ""), ("10.0.0.1", "10.0.0.1", ""), ("[::1]:80", "[::1]", ""), ("", "", ""),
    ("a.b.foo.ck", "b.foo.ck", "foo.ck"), ("a.www.ck", "www.ck", "ck"), ("ck", "ck", "ck"),
    ("a.b.school.sch.uk", "b.school.sch.uk", "school.sch.uk"), ("x.city.kobe.jp", "city.kobe.jp", "kobe.jp"),
    ("x.y.other.kobe.jp", "y.other.kobe.jp", "other.kobe.jp"), ("me.github.io", "me.github.io", "github.io")])
def test_registered_domains(spark, host, domain, suffix):
    df = spark.createDataFrame([(host,)], "h string")
    r = df.select(host_reputation.registered_domain(F.col("h")).alias("d"), host_reputation.suffix(F.col("h")).alias("s")).first()
    assert (r.d, r.s) == (domain, suffix)


def test_host_query_agrees_with_its_sql_on_odd_hosts(spark, tmp_path):
    import duckdb
    hosts = ["a.bbc.co.uk", "gov.co.uk", "10.0.0.1:80", "10.0.0.1", "[::1]:80", "a.www.ck", "b.foo.ck", "x.example.com.", "u@x.example.com:1",
             "localhost", "com", "me.github.io"]
    pages = spark.createDataFrame([(i, None if i == 7 else f"https://{hosts[i % len(hosts)]}/{i}", i) for i in range(120)],
                                  "page_id long, url string, host long")
    labels = spark.createDataFrame([(i, int(i * 7 % 5 > i % 3), int(i % 11 == 0)) for i in range(0, 120, 2)],
                                   "doc_id long, quality int, toxic int")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = queries.op4_host_reputation(spark, str(tmp_path))
    want = con.sql(queries._op4_sql()).df()[got.columns].itertuples(index=False)
    key = lambda r: tuple("" if x is None or x != x else str(x) for x in r)
    assert sorted(map(key, got.collect())) == sorted(map(key, want))


def test_host_reputation_of_empty_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string")
    bad = spark.createDataFrame([], "page_id long, bad int")
    assert host_reputation.judge(none, bad, queries.URL_RULES).count() == 0
    assert [r.verdict for r in host_reputation.judge(spark.createDataFrame([(1, None), (1, None)], none.schema), bad, []).collect()] == ["allow"] * 2


def test_a_hub_is_joined_in_many_pieces(spark):
    """One key with most rows: every piece of it is a group of its own, and the result is that of one group."""
    df = spark.range(5000).select(F.when(F.col("id") % 5 < 4, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    rows, least = common.with_least(df, "k", "v", "v", "m")
    assert rows.count() == 5000
    assert {(r.k, r.m) for r in rows.collect()} == {(r.k, r.m) for r in df.groupBy("k").agg(F.min("v").alias("m")).collect()}
    assert least.where("k = 7").count() == common.SALTS
    star = spark.range(1, 4001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    low = spark.range(4000).select(F.lit(9000).cast("long").alias("a"), (F.col("id") + 4500).alias("b"))  # the centre is the greatest
    got = {r.node: r.comp for r in common.connected_components(star.union(low), "hub").collect()}
    assert got == {**{i: 0 for i in range(4001)}, **{i: 4500 for i in [*range(4500, 8500), 9000]}}
