"""Every registered query against its DuckDB oracle on the smallest scale factor."""

import pytest

import __spark_entry__ as E
from tests.compare import compare, duck_connect
from tests.conftest import SF_SMALL

QUERIES = {k: v for k, v in E.queries().items() if k not in E.LLM_QUERIES}    # those have tests of their own
ORACLES = {k: v for k, v in E.oracle_sql().items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    return duck_connect(SF_SMALL)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    res = compare(spark, SF_SMALL, key, QUERIES[key], ORACLES.get(key), con)
    assert res["status"] in ("match", "rows-only"), res
    if res["status"] == "rows-only":
        assert res["spark_rows"] >= 0


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["l_returnflag", "value"] and df.count() > 0


def test_every_query_has_an_oracle_or_is_listed():
    assert set(QUERIES) == set(ORACLES)
