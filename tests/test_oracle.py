"""Every registered query against its DuckDB SQL on the sf0.001 tables."""
import pytest

import __spark_entry__ as E
from delayspark import registry
from tools.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
registry.load_all()
QUERIES = registry.QUERIES
ORACLE = registry.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    res = compare(spark, con, name, QUERIES[name], ORACLE.get(name), SF)
    assert res.startswith("OK"), res


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["Hour", "mean_delay"]
