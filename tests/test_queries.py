"""Every registered query against its SQL twin, and the shape of its plan."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from tests.conftest import SF  # noqa: E402
from tools.check_twins import compare, connect  # noqa: E402

NAMES = sorted(entry.queries())
MAY_USE_PYTHON = {"fuzzy_duplicates", "fuzzy_vendor_duplicates"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, con, name):
    result = compare(spark, con, SF, name)
    assert not result.startswith("FAIL"), result


@pytest.mark.parametrize("name", ["ranked_decisions", "vendor_summary", "payment_patterns", "fuzzy_duplicates", "cosine_topk",
                                  "kpi_board", "cashflow_summary", "seasonality", "bills_pairs", "distribution_summary"])
def test_plan_has_no_cross_join(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert node not in plan
    assert ("ArrowEvalPython" in plan) == (name in MAY_USE_PYTHON)


def test_rank_limit_runs_before_the_shuffle(spark):
    plan = entry.queries()["ranked_decisions"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_filters_and_columns_reach_the_scan(spark):
    from ledgerloom.plans.entities import AS_OF, Tables
    from ledgerloom.operators import lookups

    df = lookups.overdue_rows(Tables(spark, SF).invoices(False, False, False), AS_OF).select("invoice_id")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>" in plan


def test_importing_needs_no_session():
    import subprocess

    code = "import __spark_entry__ as e; assert len(e.queries()) > 140 and len(e.oracle_sql()) > 130"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_bills_pairs_finds_the_roles_once(spark):
    from ledgerloom.plans import all_queries

    plan = all_queries()["bills_pairs"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "rlike" not in plan.lower()
