"""The corpus pipeline against a stage-by-stage brute force, and the registry."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline as P
from cinerank.llm import pseudonyms, queries

from conftest import SF
from test_groups import _exact_by_hand, _near_by_hand  # noqa: F401


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and result of every stage over the sf0.001 documents."""
    folder = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in P.STAGES:
        path = str(folder / name)
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((docs, after))
        docs = after
    return out


def test_all_but_the_last_return_the_columns_of_documents(stages):
    for before, after in stages[:-1]:
        assert after.dtypes == before.dtypes


def test_quality_keeps_what_the_classifier_accepts(spark, stages):
    before, after = stages[0]
    accepted = {r.doc_id for r in queries.op6_nbsvm_quality(spark, SF).collect() if r.predicted}
    assert rows_of(after) == {i: r for i, r in rows_of(before).items() if i in accepted}


def test_exact_keeps_the_least_of_equal_texts(stages):
    before, after = stages[1]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    least = {int(keep) for _, keep, _, _ in _exact_by_hand(rows)}
    assert rows_of(after) == {i: r for i, r in rows_of(before).items() if i in least}


def test_near_keeps_the_least_of_each_group(stages):
    before, after = stages[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    least = {c for _, _, c in _near_by_hand(rows, 5, 80).values()}
    assert rows_of(after) == {i: r for i, r in rows_of(before).items() if i in least}


def test_personal_data_is_replaced_and_all_else_stays(spark, stages):
    import hashlib
    before, after = (rows_of(x) for x in stages[3])
    one = pseudonyms.replacer(hashlib.blake2b(queries.SAMPLE_KEY.encode(), digest_size=32).digest())
    assert set(before) == set(after)
    for i, r in before.items():
        text, found = one(r.text)
        assert after[i].text == text and after[i].n_chars == len(text)
        assert (text == r.text) == (sum(found) == 0)
        assert (after[i].lang, after[i].source) == (r.lang, r.source)


def test_packing_holds_every_id_once(stages):
    before, after = stages[4]
    lib, by_doc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}
    for r in after.collect():
        by_doc.setdefault(r.doc_id, []).append(r)
    docs = rows_of(before)
    assert set(by_doc) == set(docs)
    for i, r in docs.items():
        ids, at = lib.encode(r.text, add_special_tokens=False).ids + [1], 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at:at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)


def test_pipeline_on_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "x", "en", "s", 1), (2, "x", "en", "s", 1), (None, "y z", "en", "s", 3)]
    for name, data in (("odd", rows), ("none", [])):
        d = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(2, 1, 0), (3, 0, 0), (4, 0, 0), (2, None, None)], "doc_id long, quality int, toxic int").write.parquet(
            f"{d}/labels.parquet")
        got = P.run(spark, d).collect()
        # equal texts (none and empty; both x) leave one row each
        assert sorted((str(r.doc_id), r.doc_tokens) for r in got if r.start == 0) == (
            [("1", 1), ("2", 2), ("None", 3)] if data else []), got


def test_near_stage_keeps_unlinked_rows_that_share_an_id_or_have_none(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "a b", "en", "s", 3), (1, "c", "en", "s", 1), (None, "y z", "en", "s", 3), (None, "other", "en", "s", 5)]
    df = spark.createDataFrame(rows, schema)
    got = P.near(spark, P.exact(spark, df, SF), SF).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))


def test_every_operator_is_registered():
    names = E.queries()
    assert [sum(k.startswith(f"op{n}_") for k in names) for n in range(1, 11)] == [1] * 10
    assert "pipeline" in names and [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "personal_data", "packing"]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_operator_matches_its_sql(spark, name):
    import check_oracles as CK
    res = CK.compare(spark, name, queries.QUERIES[name], queries.ORACLES[name], SF, CK.duck(SF))
    assert res["status"] == "match", res


def test_extra_columns_with_clashing_names(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").limit(20)
    clash = df.withColumns({"n_tokens": F.lit("x"), "_rid": F.lit(1), "node": F.lit(2), "score": F.lit("y"),
                           **{c: F.lit(c) for c in ("_h", "_sha", "_stay_id", "_stay_h", "_stay_sha", "_id", "_key", "_salt", "_score", "_first")}})
    for _, stage in P.STAGES[:4]:
        out = stage(spark, clash, SF)
        assert out.dtypes == clash.dtypes
        assert [tuple(r) for r in out.select("_h", "_sha", "_score", "_key").distinct().collect()] in ([], [("_h", "_sha", "_score", "_key")])


def test_of_rows_with_one_id_and_text_the_same_one_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(3)
    both = docs.withColumn("source", F.lit("b")).union(docs.withColumn("source", F.lit("a"))).union(docs.withColumn("source", F.lit("c")))
    for _, stage in P.STAGES[1:3]:
        for parts in (1, 5):
            got = stage(spark, both.repartition(parts, F.xxhash64("source", "doc_id")), SF).collect()
            assert {r.source for r in got} == {"a"} and len(got) == len({r.doc_id for r in got})
