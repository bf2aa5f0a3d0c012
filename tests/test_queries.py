"""Every query of the core on the smallest tables, against its SQL where it has any."""

from pathlib import Path

import pytest

from glintframe.plans import catalogs, changes, models, retrieval

from .compare import DATA, connect, same

QUERIES = {n: f for m in (retrieval, catalogs, models, changes) for n, f in m.QUERIES.items()}
SQL = {n: s for m in (retrieval, catalogs, models, changes) for n, s in m.SQL.items()}

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    return connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name in SQL:
        same(df, duck, SQL[name])
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["query_id", "rank", "key", "score"]
