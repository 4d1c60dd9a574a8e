"""Every registered query against its SQL (or, without SQL, for rows) on the smallest tables."""

import pytest
from compare import compare, connect

import __spark_entry__ as entry_points

QUERIES, ORACLES = entry_points.queries(), entry_points.oracle_sql()
HEAVY = {"gra_features", "w2v_features", "score_members_end_to_end", "out_panel"}


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in HEAVY])
def test_query(spark, con, folder, name):
    diff, *_ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), folder)
    assert diff is None, diff


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["vec_id", "item", "score", "rank"]
    assert df.count() == 5000
