"""The source divergence audit against brute force."""

import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cinerank.llm import source_divergence as sd

SCHEMA = "text string, lang string, source string"


def by_hand(rows, least, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(lang, source, re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(lower))) for t, lang, source in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, of_lang, of_group = Counter(), Counter(), {}
        for at, source, terms in found:
            if at == lang:
                docs.update(set(terms))
                of_lang.update(terms)
                of_group.setdefault(source, Counter()).update(terms)
        kept = [t for t in docs if docs[t] >= least]

        def rate(counts, t):
            return 1 + 10**9 * (counts[t] + 2) // (sum(counts[x] for x in kept) + 2 * len(kept))

        def price(p, q):
            return (p - q) ** 2 // (p + q)
        p = {g: {t: rate(c, t) for t in kept} for g, c in of_group.items()}
        q = {t: rate(of_lang, t) for t in kept}
        for g in of_group:
            pairs = [(-sum(price(p[g][t], p[h][t]) for t in kept), h.encode()) for h in of_group if h != g]
            terms = [(-price(p[g][t], q[t]), t.encode()) for t in kept if of_group[g][t] and p[g][t] > q[t]]
            out += [(lang, g, "pair", h.decode(), -v, i) for i, (v, h) in enumerate(sorted(pairs), 1)]
            out += [(lang, g, "term", t.decode(), -v, i) for i, (v, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


def sample(seed=3, n=160):
    r = random.Random(seed)
    words = [f"w{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]}" for i in range(60)] + ["É", "é", "日本", "İ", "ß", "KelvinK"]
    rows = []
    for _ in range(n):
        source = r.randrange(9)
        own = words[source * 5:source * 5 + 20] + words[-6:]
        rows.append((" ".join(r.choice(own) for _ in range(r.randrange(30))) + "1x-Y_z", r.choice(["en", "de"]), f"s{source}"))
    rows += [(None, "en", "s1"), ("", "en", "only empty"), ("Wak WAK wak", None, None), ("x", "one", "alone"), ("q", "none", "a"),
             ("q", "none", "b"), ("12 34", "en", None), ("wak " * 3000, "en", "s2"), ("w\x00ak\x7fw", "de", "sé")]
    return rows + rows[:7]


def run(df, **options):
    return sorted(tuple(r) for r in sd.audit(df, **options).collect())


def test_audit_by_hand(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("Term", F.lit("x")).withColumn("n", F.lit(1)).withColumn(
        "doc_id", F.when(F.rand(1) < 0.8, F.lit(7)))
    for options in ({"least_docs": 5}, {"least_docs": 5, "band": 2, "width": 16}, {"least_docs": 2, "band": 3, "width": 5, "top": 3}):
        assert run(df, **options) == by_hand(rows, options["least_docs"], options.get("top", 10))
    assert run(df, least_docs=10**6) == by_hand(rows, 10**6)
    assert run(df.limit(0)) == []


def test_counts_are_handed_on_in_parts(monkeypatch, spark):
    import pyarrow as pa
    monkeypatch.setattr(sd, "FLUSH", 5)
    batch = pa.RecordBatch.from_pydict({"lang": ["a"] * 4, "source": ["s", "s", "t", "s"],
                                        "text": ["b b c d e f g", "B", "", "b h i j k l m"]})
    total, docs = Counter(), Counter()
    parts = list(sd.count_terms(iter([batch, batch])))
    assert len(parts) > 2
    for p in parts:
        for _, s, t, n, d in zip(*p.to_pydict().values()):
            total[s, t] += n
            docs[s, t] += d
    assert total["s", "b"] == 8 and docs["s", "b"] == 6 and ("t", None) in total


def test_quadtree_prices_like_all_cells():
    r = np.random.default_rng(1)
    for rows, cols, share in ((1, 1, 1), (5, 7, 0.3), (17, 70, 0.02), (33, 300, 0.005), (8, 64, 0)):
        count = r.integers(1, 1000, (rows, cols)) * (r.random((rows, cols)) < share)
        totals = count.sum(1)
        rate = np.stack([sd.rates(c, int(t), cols) for c, t in zip(count, totals)])
        none = np.array([sd.rates(np.zeros(1, np.int64), int(t), cols)[0] for t in totals])
        levels = next(n for n in range(1, 9) if sd.K ** n >= max(rows, cols))
        want = sd.price(rate[:, None, :], rate[None, :, :]).sum(-1)
        for cut in {rows, max(1, rows // 2)}:
            got = sd.pair_prices(rate, none, sd.Quadtree(count > 0, levels), cut)
            g, h = np.triu_indices(rows, 1)
            keep = (cut == rows) | ((g < cut) & (h >= cut))
            assert (got[g, h] == want[g, h])[keep].all()


def test_rates_are_exact_for_large_totals():
    for count, total, kept in ((0, 0, 1), (10**14 + 7, 8 * 10**15, 12345), (5, 7, 3)):
        assert sd.rates(np.array([count]), total, kept)[0] == 1 + 10**9 * (count + 2) // (total + 2 * kept)
