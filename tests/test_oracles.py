"""Every registered query against its oracle."""

import pytest

import __spark_entry__ as entry_point
from compare import compare, duck
from oracles.cases import ROWS_ONLY

# The training-data operators have tests of their own.
OTHER = entry_point._LLM_QUERIES.keys()
QUERIES = {k: v for k, v in entry_point.queries().items() if k not in OTHER}
ORACLES = {k: v for k, v in entry_point.oracle_sql().items() if k not in OTHER}


@pytest.fixture(scope="module")
def con(folder):
    return duck(folder)


def test_all_but_the_named_queries_have_an_oracle():
    assert QUERIES.keys() == ORACLES.keys() | ROWS_ONLY.keys()


def test_sized_sample_keeps_about_a_quarter(spark, folder):
    n = QUERIES["s04_sized_sample"](spark, folder).count()
    assert 0.22 < n / spark.read.parquet(f"{folder}/lineitem.parquet").count() < 0.28


def test_p_values_are_probabilities(spark, folder):
    rows = QUERIES["m06_p_values"](spark, folder).collect()
    assert len(rows) == 36 and all(0 <= r.p_value <= 1 for r in rows)


@pytest.mark.parametrize("name", list(ORACLES))
def test_query(spark, con, folder, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], folder) is None


def test_flagship(spark):
    rows = entry_point.entry(spark).collect()
    assert rows and all(r.number_of_systems >= 5 and r.avg_duration <= 60 for r in rows)
