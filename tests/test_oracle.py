"""Every query with an oracle: Spark result == DuckDB result on the same parquet tables."""
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from cohortlab.plans.compare import compare, duck

from .conftest import SF_SMALL

ORACLE = oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(queries())


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["client_i", "client_j", "emd_value", "emd_label", "tv_distance"]
    assert df.count() == 10


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    ok, msg = compare(queries()[name](spark, SF_SMALL), con, ORACLE[name])
    assert ok, msg
