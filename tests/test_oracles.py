"""Every registered query that has an oracle agrees with DuckDB on the
driver tables (sf0.001): same columns, same rows, same values."""

import os
import subprocess
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import check_oracles as CK  # noqa: E402
from cinerank.plans.catalog import ORACLES, QUERIES  # noqa: E402

from conftest import SF  # noqa: E402


@pytest.fixture(scope="module")
def con():
    return CK.duck(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    res = CK.compare(spark, name, QUERIES[name], ORACLES[name], SF, con)
    assert res["status"] == "match", res


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_registry_without_the_training_data_operators():
    """The entry module imports and lists the library's queries where the llm
    subpackage and the pipeline are not there."""
    code = """
import importlib.util, sys
find = importlib.util.find_spec
importlib.util.find_spec = lambda n, *a: None if n in ("cinerank.llm", "corpus_pipeline") else find(n, *a)
import __spark_entry__ as E
assert "training_samples" in E.queries() and not [k for k in E.queries() if k.startswith("op") or k == "pipeline"]
assert not [m for m in sys.modules if m.startswith("cinerank.llm")]
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], check=True, cwd=root)
