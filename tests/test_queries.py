"""Every registered query without the llm subpackage against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from ledgerwing.plans import load_all
from tests.compare import connect, rows

CATALOG = load_all()


@pytest.mark.parametrize("name", sorted(CATALOG.QUERIES))
def test_query(spark, sf_dir, name):
    df = CATALOG.QUERIES[name](spark, sf_dir)
    found = rows(df.columns, [tuple(r) for r in df.collect()])
    if name in CATALOG.ORACLES:
        result = connect(sf_dir).sql(CATALOG.ORACLES[name])
        assert found == rows(list(result.columns), result.fetchall())


def test_entry(spark, sf_dir):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
