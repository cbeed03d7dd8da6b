"""Correctness gate: every catalog key against its independent SQL (DuckDB)
on the smallest test tables; keys without SQL must at least run."""

import pytest

import __spark_entry__ as E
from regstat.plans.catalog import queries as _queries
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck

KEYS = sorted(_queries())


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_key_has_sql_or_is_documented():
    no_sql = set(KEYS) - set(E.oracle_sql())
    assert not {k for k in no_sql if not k.startswith(("op", "pipeline"))}


@pytest.mark.parametrize("name", KEYS)
def test_key(spark, con, name):
    fn = E.queries()[name]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert fn(spark, SF_SMALL).count() > 0
        return
    ok, n, _, detail = compare(spark, con, name, fn, sql, SF_SMALL)
    assert ok, detail
    assert n > 0


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["departamento", "anio", "casos", "poblacion", "tasa"]
