"""Every registered query against its DuckDB twin on the smallest data set."""

import pytest

from workload import queries  # noqa: F401
from workload.check import compare, connect
from workload.registry import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
#: Reports that are rightly empty at this size.
EMPTY = {"orphan_report"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    problem = compare(spark, FOLDER, name, duck)
    assert problem is None or (problem == "no rows" and name in EMPTY), problem


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"listed_folder"}


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns == ["pk", "tournament", "miniature", "name", "teams", "status", "description"]
    assert df.count() == spark.read.parquet(f"{FOLDER}/customer.parquet").count()
