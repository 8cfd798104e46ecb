"""Every registered query against its SQL statement on the given tables."""

import os

import compare
import pytest

import __spark_entry__ as contract

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLE = contract.oracle_sql()
QUERIES = contract.queries()


@pytest.fixture(scope="module")
def con():
    return compare.connect(SF_DIR)


def test_statements_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
    # Only text operators are beyond SQL.
    assert all(name.startswith(("op", "pipeline")) for name in set(QUERIES) - set(ORACLE))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, con, name):
    assert compare.differences(spark, con, QUERIES[name], ORACLE[name], SF_DIR) == ""


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == [
        "SubjectID", "EpochID", "Electrode", "WaveBand", "FeatureName", "FeatureValue", "table_type",
    ]
    assert df.count() == 210 * 17
