"""Every query against its SQL on the small tables; the others must run."""

import pytest

from tests.compare import canonical, duck
from tapewright.plans import all_catalogs

ENTRIES = {n: e for c in all_catalogs() for n, e in c.entries.items()}


@pytest.fixture(scope="module")
def con(data):
    return duck(data)


@pytest.mark.parametrize("name", list(ENTRIES))
def test_query(spark, data, con, name):
    df = ENTRIES[name].run(spark, data)
    got = canonical(df.columns, df.collect())
    sql = ENTRIES[name].sql
    if sql is None:
        assert got
        return
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == canonical(rel.columns, rel.fetchall())


def test_entry_names(spark):
    import __spark_entry__ as entry

    assert set(ENTRIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
