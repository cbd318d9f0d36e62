"""Every query with SQL against DuckDB on the small tables; the others must run and repeat themselves."""

import pytest

from compare import compare, duck
from ledgerlens.plans import checks, problems, reference

SF = "/root/testdata/sf0.001"
ALL = {**reference.QUERIES, **checks.QUERIES, **problems.QUERIES}
SQL = {**reference.SQL, **checks.SQL, **problems.SQL}


@pytest.fixture(scope="module")
def conn():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(ALL))
def test_query(spark, conn, name):
    ok, said = compare(spark, SF, name, ALL[name], SQL.get(name), conn)
    assert ok, said


def test_every_query_has_sql():
    assert set(ALL) == set(SQL)
