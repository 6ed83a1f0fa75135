"""Every registered query of the engine's own operators against its SQL on the smallest tables."""

import pytest

from corpusloom.plans import registry

from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SMALL)
    rows = [tuple(r) for r in df.collect()]
    if name not in registry.ORACLE_SQL:
        assert rows
        return
    want = duck.sql(registry.ORACLE_SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    assert sorted(rows, key=key) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["query_id", "recall", "precision", "mrr", "ndcg", "missed"]
    assert {*registry.ORACLE_SQL} <= {*e.oracle_sql()} <= {*e.queries()}
