"""Every registered query against its DuckDB oracle (the driver's check, run
locally on the smallest scale factor)."""

import os

import pytest

from oracle import compare, duck
from spoofscope.plans.registry import ORACLES, QUERIES, load_all

load_all()
SF = os.environ.get("SPOOFSCOPE_TEST_SF", "/root/testdata/sf0.001")
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLES))


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_oracle(spark, con, key):
    r = compare(QUERIES[key](spark, SF), ORACLES[key], con)
    assert r.get("ok"), r


def test_queries_without_an_oracle_are_the_fitted_models():
    """Their results are checked in tests/test_models.py, which names each of them."""
    with open(os.path.join(os.path.dirname(__file__), "test_models.py")) as fh:
        text = fh.read()
    assert [k for k in ROWS_ONLY if f'got("{k}")' not in text] == ["train_trajectory"]  # within model_summary


def test_entry_smoke(spark):
    import importlib.util
    spec = importlib.util.spec_from_file_location(
        "entry", os.path.join(os.path.dirname(os.path.dirname(__file__)), "__spark_entry__.py"))
    mod = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(mod)
    df = mod.entry(spark)
    assert df.count() > 0 and "cn0_est_prompt" in df.columns
    assert set(mod.oracle_sql()) <= set(mod.queries())
