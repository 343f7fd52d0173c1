"""Physical-plan properties of the registered queries: no cross joins, and
top-k is cut before the shuffle."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cinerank.plans.catalog import QUERIES  # noqa: E402

from conftest import SF  # noqa: E402

MODEL_QUERIES = {"pair_model", "pair_mlp_model", "pair_factors", "mlp_model", "wide_deep_model", "fm_model", "interest_model",
                 "model_metrics", "model_roundtrip", "recommend_model", "recommend_clicks", "item2vec", "graph_embedding", "item2vec_neighbors"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - MODEL_QUERIES))
def test_no_cross_join(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name", ["top_ratings", "genre_shelves", "genre_page_by_year", "similar_items_default"])
def test_top_k_uses_partial_group_limit(spark, name):
    plan = _plan(QUERIES[name](spark, SF))
    assert "WindowGroupLimit" in plan, name


def test_scans_read_only_needed_columns(spark):
    plan = _plan(QUERIES["user_profiles"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_training_samples_shuffle_whole_rows_few_times(spark):
    plan = _plan(QUERIES["training_samples"](spark, SF))
    assert "Scan ExistingRDD" not in plan


def test_no_query_replicates_all_against_all(spark):
    """A search for all vectors compares cell by cell."""
    from cinerank.operators import vectors as V
    from cinerank.sources import tables as T
    v = T.item_vectors(spark, SF)
    plan = _plan(V.approx_neighbors(v, v.select("movieId"), 5))
    assert "cell" in plan.split("FlatMapCoGroupsInPandas")[1][:400]


@pytest.mark.parametrize("name, most", [("user_sequences", 0), ("adjacent_pairs", 0), ("item_distribution", 0), ("training_samples", 1)])
def test_ordered_rows_are_read_from_their_sources_once(spark, name, most):
    """One scan wrote the positions' rows when the plan was made; what is left are the item statistics."""
    plan = _plan(QUERIES[name](spark, SF))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line and "ReadSchema: struct<l_orderkey" in line]
    assert len(scans) <= most, name


def test_similar_items_shuffle_no_scored_pairs_with_vectors(spark):
    """Seeds meet a genre's list as one row; what is grouped by seed holds ids and scores only."""
    plan = _plan(QUERIES["similar_items_emb"](spark, SF))
    top = plan[:plan.index("Join")]
    assert "collect_list(best" in top and "candEmb" not in top.split("Project")[0]


def test_load_counts_read_every_source_once(spark):
    plan = _plan(QUERIES["load_counts"](spark, SF))
    assert sum("FileScan parquet" in line and "struct<l_" in line for line in plan.splitlines()) == 1
