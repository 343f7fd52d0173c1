"""The low-discrepancy source schedule: targets, streams and schedule by brute force."""

import hashlib
import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from cinerank.llm import source_mix

SCHEMA = "doc_id long, text string, source string"


def by_hand(rows, weights=(5, 2, 1), percent=150, repeats=2):
    """Rows -> sorted (doc_id, size, source_size, target, taken)."""
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    words = {n: sum(count(t) for _, t, s in rows if s == n) for n in names}
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, at_limit = Fraction(percent * sum(words.values()), 100), set()
    while True:
        free = [n for n in names if n not in at_limit]
        rest = total - sum(repeats * words[n] for n in at_limit)
        target = {n: Fraction(repeats * words[n]) if n in at_limit else rest * weight[n] / sum(weight[x] for x in free) for n in names}
        over = {n for n in free if target[n] > repeats * words[n]}
        if not over:
            break
        at_limit |= over
    out = []
    for n in names:
        def key(r):
            h = hashlib.md5("|".join(["mix", "" if r[0] is None else str(r[0]), r[1] or ""]).encode()).hexdigest()
            return int(h[:15], 16), r[0] is not None, r[0] or 0
        stream = [i for i, r in enumerate(sorted((r for r in rows if r[2] == n), key=key)) for _ in range(count(r[1]))]
        docs = sorted((r for r in rows if r[2] == n), key=key)
        want = int(target[n])
        got = [stream[i % len(stream)] for i in range(want)] if stream else []
        out += [(str(r[0]), count(r[1]), words[n], float(target[n]), got.count(i)) for i, r in enumerate(docs)]
    return sorted(out)


def sample():
    rows = [(i, " ".join(f"w{i}_{j}" for j in range(i * 7 % 23)), "abcd"[i % 4] if i % 9 else "hot") for i in range(60)]
    rows += [(100, " \t one\x0btwo\x0cthree\xa0x ", None), (101, None, None), (None, "a b c", "a"), (None, "a b c", "a"),
             (5, "again the same id", "b"), (5, "again the same id", "b"), (102, "", "empty"), (103, "w " * 5000, "hot"),
             (104, "é ü ß", "é")]
    return rows


def test_words_taken_by_hand(spark):
    rows = sample()
    df = spark.createDataFrame(rows, SCHEMA).withColumn("no", F.lit(1)).withColumn("SIZE", F.lit("x"))
    for options in ({}, {"block": 16, "rows_per_range": 4}, {"block": 7, "weights": (1, 3), "percent": 180}):
        parts = source_mix.mix(df, **options)
        got = sorted((str(r.doc_id), r.size, r.source_size, r.target, r.taken) for r in source_mix.taken_words(*parts).collect())
        want = by_hand(rows, options.get("weights", (5, 2, 1)), options.get("percent", 150))
        assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want])
        assert all(g[4] <= 2 * g[1] for g in got)


def test_the_mix_is_the_schedule(spark):
    """Slots are van der Corput points, pieces of a slot join up, passes follow each other, prefixes are balanced."""
    rows = [(i, " ".join(["w"] * (20 + i % 30)), "abc"[min(i % 5, 2)]) for i in range(400)]
    docs, mixed = source_mix.mix(spark.createDataFrame(rows, SCHEMA), block=32)
    pieces = sorted(mixed.collect(), key=lambda r: (r.slot, r["at"]))
    total, targets = sum(r.length for r in pieces), {r.source: r.target for r in docs.collect()}
    assert total == sum(int(t) for t in targets.values())
    place = {}
    for r in pieces:
        if r.slot in place:
            assert place[r.slot][:2] == (r.source, r["pass"]) and place[r.slot][2] == r["at"]
        place[r.slot] = (r.source, r["pass"], r["at"] + r.length)
    done = {}
    for s in sorted(place):  # a source's first pass ends before its second begins
        assert done.get(place[s][0], 0) <= place[s][1]
        done[place[s][0]] = place[s][1]
    taken, so_far, slots = dict.fromkeys(targets, 0), 0, {r.slot for r in pieces}
    for r in pieces:
        taken[r.source] += r.length
        so_far += r.length
        assert all(abs(taken[s] - so_far * targets[s] / total) < 32 * len(slots).bit_length() for s in targets)
    # each source's first pass reads each of its words once
    for s in targets:
        first = sorted((r.nth, r.range, r.begin, r.length) for r in pieces if r.source == s and r["pass"] == 0)
        assert sum(x[-1] for x in first) == min(int(targets[s]), sum(len(t.split()) for _, t, x in rows if x == s))


def test_rank_of_slots(spark):
    for bits, first, end in ((1, 0, 1), (5, 3, 17), (7, 0, 128), (6, 11, 12)):
        order = sorted(range(1 << bits), key=lambda c: int(format(c, f"0{bits}b")[::-1], 2))
        want = {c: i for i, c in enumerate(c for c in order if first <= c < end)}
        cells = spark.range(first, end).withColumn("r", source_mix.slot_rank(F.col("id"), F.lit(first), F.lit(end), bits))
        assert {r.id: r.r for r in cells.collect()} == want
        back = spark.range(1 << bits).withColumn("k", source_mix.reversed_bits(F.col("id"), bits)).collect()
        assert [order[r.k] for r in back] == [r.id for r in back]


def test_mix_of_nothing_and_any_partitioning(spark):
    assert source_mix.taken_words(*source_mix.mix(spark.createDataFrame([], SCHEMA))).collect() == []
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], SCHEMA)
    assert [(r.doc_id, r.size, r.target, r.taken) for r in
            source_mix.taken_words(*source_mix.mix(blank)).orderBy("doc_id").collect()] == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]
    df = spark.createDataFrame(sample(), SCHEMA)
    one, other = (source_mix.mix(d, block=16)[1].drop("nth").collect() for d in (df, df.repartition(7).orderBy(F.desc("text"))))
    assert sorted(map(str, one)) == sorted(map(str, other))


def test_no_python_on_the_main_path(spark):
    df = spark.createDataFrame([(1, "a b", "x")], SCHEMA)
    plan = source_mix.taken_words(*source_mix.mix(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
