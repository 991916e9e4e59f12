"""Every registered query with a SQL twin agrees with DuckDB on sf0.001."""

import pytest

import __spark_entry__ as E
from oracle import compare, duck

SF = "/root/testdata/sf0.001"
FAST = ["hourly_agg", "featured_table", "forward_labels_1d", "smu_row_stats", "healthy_baseline",
        "walk_forward_folds", "roc_auc", "macro_metrics", "classification_report", "risk_board",
        "risk_distribution", "serve_complete", "intent_routing", "prompt_column", "last_n_readings"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, con, name):
    res = compare(E.queries()[name](spark, SF), con, E.oracle_sql()[name])
    assert res["values_match"], res


def test_every_sql_has_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    rows = E.entry(spark).collect()
    assert sum(r.n_rows for r in rows) == 951
