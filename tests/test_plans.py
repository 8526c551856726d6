"""Physical-plan checks: pushdown, pruning, no pairing joins, no Python UDFs,
partial aggregation before shuffles, reuse of the employee partitioning."""

import re

import pytest

from rota.operators import intervals as iv
from rota.plans import catalog
from rota.plans.reports import VARIANTS, employee_report
from rota.sources.roles import role_tables
from tests.conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
             "ArrowEvalPython", "FlatMapGroupsInPandas")


def plan_of(df) -> str:
    """The plan that ran: the frame's own execution, after AQE."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    if plan.startswith("AdaptiveSparkPlan"):
        assert plan.startswith("AdaptiveSparkPlan isFinalPlan=true")
    # Scalar subqueries print their own plans inside; the part that matters is
    # what stands before the plan as it was first made.
    return plan.rpartition("\n+- == Initial Plan ==")[0] or plan


REPORTS = [(v, n) for v in VARIANTS for n in (VARIANTS[v].top_n, None)]


def assembly(spark, variant: str, top_n: int | None):
    """The report before its sort: the plan that puts the documents together."""
    return employee_report(role_tables(spark, SF_SMALL), variant, top_n=top_n, ordered=False)


@pytest.mark.parametrize("name", ["location_ranges", "change_blocks", "allow_list_in",
                                  "access_flags_global"])
def test_no_pairing_joins_and_no_python(spark, name):
    plan = plan_of(catalog.queries()[name](spark, SF_SMALL))
    for op in FORBIDDEN:
        assert op not in plan, f"{name}: {op}"


@pytest.mark.parametrize("variant", VARIANTS)
def test_ordered_reports_sort_finished_documents(spark, variant):
    plan = plan_of(catalog.queries()[f"report_{variant}_all"](spark, SF_SMALL))
    assert plan.count("Scan ExistingRDD") == 1 and "Join" not in plan and "FileScan" not in plan


@pytest.mark.parametrize("variant, top_n", REPORTS)
def test_reports_read_their_shared_inputs(spark, variant, top_n):
    plan = plan_of(assembly(spark, variant, top_n))
    for op in FORBIDDEN:
        assert op not in plan, op
    assert "Scan ExistingRDD" in plan                   # the checkpointed inputs
    scans = re.findall(r"FileScan parquet [^\n]*?/(\w+)\.parquet", plan)
    assert "events" not in scans                        # the roster is not read again
    # v5 reads its intervals once; v1 the whole mapping once for its global flags,
    # in a subquery that prints its first and its final plan.
    most = {"v5": 1, "v1": 2}.get(variant, 0)
    assert scans.count("orders") <= most


def test_ip_rows_stay_flat_up_to_their_owner(spark):
    plan = plan_of(catalog.queries()["allow_list_in"](spark, SF_SMALL))
    below = plan[plan.index("collect_list"):]
    assert below.index("Join") > 0 and "collect_list" not in below[below.index("Join"):]


def test_owners_are_restricted_below_the_expansion(spark):
    t = role_tables(spark, SF_SMALL)
    owners = t.employees.select("ed_empcode")
    out = iv.resolved_ranges(t.mapping, "EmployeeCode", "FromDate", "ToDate", "LocationID", owners=owners)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("LeftSemi")


def test_scans_read_only_needed_columns(spark):
    plan = plan_of(assembly(spark, "v3", 10))
    for schema in re.findall(r"ReadSchema: struct<([^>]*)>", plan):
        assert "value:" not in schema           # events.value is never needed
        assert "c_acctbal" not in schema        # customer.c_acctbal is never needed


def test_global_flags_are_scalar_subqueries(spark):
    plan = plan_of(catalog.queries()["access_flags_global"](spark, SF_SMALL))
    assert "Subquery" in plan


def test_change_blocks_preaggregates_before_shuffle(spark):
    t = role_tables(spark, SF_SMALL)
    plan = plan_of(iv.change_blocks(t.roster, "EmpCode", "Date", "ShiftID"))
    assert "partial_count" in plan


def test_resolution_is_a_partial_aggregate(spark):
    t = role_tables(spark, SF_SMALL)
    plan = plan_of(iv.resolve_overlaps(t.mapping, "EmployeeCode", "FromDate", "ToDate",
                                       "LocationID"))
    assert "partial_max" in plan and "Window" not in plan


def test_shared_lists_are_streamed_past_the_owners(spark):
    plan = plan_of(catalog.queries()["allow_list_shared"](spark, SF_SMALL))
    (join,) = [line for line in plan.splitlines() if re.search(r"Join.*LocationSet", line)]
    assert "ShuffledHashJoin" in join and "BuildLeft" in join
