"""Registered queries against their SQL, on the smallest tables.

``python tools/compare.py`` runs all of them at any scale.
"""

import os

import compare
import pytest

import __spark_entry__ as entry

TABLES = "/root/testdata/sf0.001"
CHECKED = ["parse_money", "parse_dates", "extract_merchant", "classify_rules", "dedup_near",
           "scan_csv_statement", "normalize_table_rows", "monthly_summary", "running_balance",
           "frequency_recurring", "health_score", "recommendations", "cashflow_forecast",
           "upsert_snapshots", "manual_ledger", "trigram_search", "chat_intents",
           "ingest_statements", "transaction_records"]

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="tables not present")


@pytest.fixture(scope="module")
def con():
    return compare.connection(TABLES)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    verdict, _, rows = compare.compare(spark, con, entry.queries()[name],
                                       entry.oracle_sql()[name], TABLES)
    assert verdict == "ok"
    assert rows > 0


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["user_id", "category", "total"]


@pytest.mark.parametrize("name", ["user_features", "recommendations", "clean_transactions",
                                  "cashflow_forecast", "scan_csv_statement"])
def test_plans_stay_in_the_engine(spark, name):
    plan = entry.queries()[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    for node in ("PythonUDF", "ArrowEvalPython", "CartesianProduct",
                 "BroadcastNestedLoopJoin"):
        assert node not in plan


def test_only_needed_columns_are_read(spark):
    plan = entry.queries()["period_summary"](spark, TABLES)._jdf.queryExecution() \
        .executedPlan().toString()
    schema = plan[plan.index("ReadSchema"):]
    assert "o_orderpriority" not in schema and "o_totalprice" in schema
