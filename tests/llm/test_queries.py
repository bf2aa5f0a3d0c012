"""Every query of the subpackage on the smallest tables, against its SQL where it has any."""

from pathlib import Path

import pytest

from glintframe.llm import queries

from ..compare import DATA, connect, same

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    if name in queries.SQL:
        same(df, connect(), queries.SQL[name])
    else:
        rows = df.collect()
        assert len({str(r) for r in rows}) == len(rows)
