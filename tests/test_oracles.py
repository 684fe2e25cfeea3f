"""Every registered query of the core against its SQL at the smallest scale."""

from pathlib import Path

import pytest
from comparing import compare, connect

from tallyfield.plans import problems, reference, reports  # noqa: F401  (reports adds to reference's queries)

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = problems.QUERIES | reference.QUERIES, problems.SQL | reference.SQL
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    assert not compare(spark, con, name, QUERIES[name], SQL[name], FOLDER)


@pytest.mark.parametrize("name", ["point_clusters", "rectangle_clusters", "line_clusters", "polygon_consensus", "connected_transcriptions", "hard_em"])
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
