"""Intermediate tables: what stays on disk, and for how long."""

import os
import re

import numpy as np
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import functions as F

from cinerank.operators import ctr as M
from cinerank.operators import vectors as V
from cinerank.plans import q_ctr
from cinerank.session import SHUFFLE_CLEANUP, let_go, settled, shared_path, write_once

from conftest import SF


def _tables(spark):
    folder = shared_path(spark, "").removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def _new(spark, before):
    return sorted(re.sub(r"-[0-9a-f]{32}$", "", x) for x in _tables(spark) - before)


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle")}


def test_a_written_table_leaves_no_shuffle_files(spark):
    """they stayed until the driver's collector met their owners."""
    before, conf = _shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    rows = spark.range(5000).repartition(4, "id").withColumn("k", F.col("id") % 7)
    out = write_once(rows.groupBy("k").count(), "counts")
    assert not _shuffle_files(spark) - before and spark.conf.get(SHUFFLE_CLEANUP, None) == conf
    assert out.columns == ["k", "count"] and out.agg(F.sum("count")).first()[0] == 5000
    assert rows.count() == 5000  # the source can be run again
    let_go(out)
    assert "counts" not in {x.rsplit("-", 1)[0] for x in _tables(spark)}


def test_settled_rows_outlive_the_tables_on_their_way(spark):
    """steps were kept until the end of the application."""
    before = _tables(spark)
    inner = lambda: write_once(spark.range(10), "step").where("id > 2")
    out = settled(lambda: write_once(settled(inner, "inner"), "other").where("id > 3"), "whole")
    assert _new(spark, before) == ["whole"] and out.count() == 6


def test_model_rows_are_written_once_and_without_vectors(spark):
    """The samples' tables are let go, and rows hold a factor once."""
    before = _tables(spark)
    tr, te = q_ctr._parts(spark, SF)
    assert _new(spark, before) == ["parts"] and tr.count() > te.count() > 0
    coded, _, f = q_ctr._coded_parts(spark, SF)
    assert isinstance(coded.schema["ufVec"].dataType, VectorUDT)
    stored = spark.read.parquet(coded.inputFiles()[0])
    assert not [c for c, t in stored.dtypes if t == "vector"] and "uf" in stored.columns
    whole = coded.where("pairDot is not null and vfVec is not null")
    assert whole.count() == coded.count() and f.rank == 10


def test_samples_without_a_candidate_vector_meet_nothing(spark):
    """all samples were shuffled by key to meet the few histories; repeated vectors still repeat rows."""
    vec = spark.createDataFrame([(1, [1.0, 2.0]), (9, [1.0, 1.0]), (9, [2.0, 0.0]), (9, None), (5, None), (5, None), (None, [1.0])],
                                "movieId long, emb array<float>")
    rows = [(7, 9, 1), (7, 5, 1), (7, 6, 1), (None, 9, 1), (8, None, 1), (8, 1, None)]
    s = spark.createDataFrame(rows, "userId long, movieId long, userRatedMovie1 long")
    made = []

    def make():
        made.append(1)
        return write_once(s, "made")

    before = _tables(spark)
    out = M.interest_vector(make, vec, ["userId", "movieId"], n=1)
    assert made == [1] and _new(spark, before) == ["interest"]
    got = sorted(((r.userId or 0, r.movieId or 0, r.nSlots, r.interest and [float(x) for x in r.interest]) for r in out.collect()), key=str)
    zero = [0.0] * 8
    want = [(7, 9, 1, [0.0, 1.0, 1.0, 2.0, 1.0, 1.0, 1.0, 2.0]), (7, 9, 1, [-1.0, 2.0, 1.0, 2.0, 2.0, 0.0, 2.0, 0.0]), (7, 9, None, None),
            (7, 5, None, None), (7, 5, None, None), (7, 6, None, None), (0, 9, 0, zero), (0, 9, 0, zero), (0, 9, None, None),
            (8, 0, None, None), (8, 1, 0, zero)]
    assert got == sorted(want, key=str)
    assert "Union" in out._jdf.queryExecution().optimizedPlan().toString()


def test_probes_in_turns_find_the_same_neighbours(spark):
    """all probes were sent to all cells they visit at once."""
    r = np.random.default_rng(8)
    v = spark.createDataFrame([(i, [float(x) for x in r.normal(size=6)]) for i in range(400)], "movieId long, emb array<float>").checkpoint()
    index = V.fit_cells(v, "cosine", 5, cells=12)
    ask = lambda **kw: V.approx_neighbors(v, v.select("movieId"), 5, "cosine", index, **kw)
    rows = lambda df: sorted(map(tuple, df.select("qid", "cid", "score", "rank").collect()))
    before = _tables(spark)
    turns = ask(visits_at_once=1000)
    new = _new(spark, before)
    assert index.visits > 1 and new.count("neighbors") > 1 and set(new) == {"cells", "neighbors"}
    assert rows(turns) == rows(ask())


def test_models_score_in_a_session_that_has_observed_a_query(spark):
    """F8: the training summary took the session along into scoring tasks, which failed after any observed query."""
    from pyspark.sql import Observation

    from cinerank.operators import click_models as C
    seen = Observation()
    assert spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count() == seen.get["n"] == 3
    df = spark.range(60).select(F.col("id").alias("userId"), (F.col("id") % 7).alias("movieId"), (F.col("id") % 2).cast("int").alias("label"),
                                (F.col("id") % 2 + F.col("id") % 3).cast("double").alias("x"))
    for fitted in (M._logistic(df, ["x"]), M._fit_mlp(df, [M.VectorAssembler(inputCols=["x"], outputCol="features")], (3,), 5, 1)):
        assert write_once(M.predict(fitted, df).select("score"), "scores").where("score between 0 and 1").count() == 60
    machine = C.fit_machine(df, C.PAIR_IDS, slots=64, max_iter=2)
    assert write_once(C.machine_logit(machine, df), "logits").count() == 60
