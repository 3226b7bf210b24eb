"""Every registered query against its plain SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks import ORACLES, QUERIES
from tests.conftest import rows


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_plain_sql(name, spark, folder, duck):
    got = QUERIES[name](spark, folder)
    cursor = duck.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    places = [names.index(c) for c in sorted(names)]
    want = sorted((tuple(r[p] for p in places) for r in cursor.fetchall()), key=repr)
    assert rows(got) == want


def test_every_query_has_plain_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_entry(spark):
    assert entry(spark).count() > 0
