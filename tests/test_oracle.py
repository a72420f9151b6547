"""Every registered query against its DuckDB oracle (sf0.001)."""

import pytest

import __spark_entry__ as entry_mod
from glazier import registry
from oracle_check import compare, duck_connection

SF = "/root/testdata/sf0.001"
ORACLE = {name: sql for name, sql in registry.ORACLE.items() if name in registry.QUERIES}
QUERIES = registry.QUERIES


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, duck, name):
    res = compare(QUERIES[name](spark, SF), duck, ORACLE[name])
    assert res["ok"], res


def test_every_query_has_oracle_or_is_rows_only():
    rows_only = set(QUERIES) - set(ORACLE)
    assert rows_only <= {"invoice_history_json"}


def test_the_entry_module_has_every_query():
    assert set(QUERIES) <= set(entry_mod.queries()) and set(ORACLE) <= set(entry_mod.oracle_sql())


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert df.columns == ["store_id", "store_name", "total_revenue", "current_month_revenue", "today_revenue"]
