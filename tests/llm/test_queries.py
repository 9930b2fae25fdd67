"""Queries of this folder against their SQL on the small tables; the others must run."""

import pytest

from tapewright.llm.queries import CATALOG
from tests.compare import canonical, duck


@pytest.mark.parametrize("name", list(CATALOG.entries))
def test_query(spark, data, name):
    df = CATALOG.entries[name].run(spark, data)
    got = canonical(df.columns, df.collect())
    sql = CATALOG.entries[name].sql
    if sql is None:
        assert got
        return
    rel = duck(data).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == canonical(rel.columns, rel.fetchall())
