"""Roles from the session's catalog: names, column maps, what is missing."""

import pytest

from rota.plans import reports
from rota.sources import role_tables, roster_tables
from rota.sources.roles import ROLE_COLUMNS
from tests.conftest import SF_SMALL


@pytest.fixture()
def names(spark):
    t = role_tables(spark, SF_SMALL)
    out = {}
    for role in ROLE_COLUMNS:
        out[role] = f"named_{role}"
        getattr(t, role).createOrReplaceTempView(out[role])
    yield out
    for view in out.values():
        spark.catalog.dropTempView(view)


def rows(df):
    return sorted(map(str, df.collect()))


def test_report_from_views_equals_the_report_from_files(spark, names):
    got = reports.employee_report(roster_tables(spark, names), "v3", top_n=5)
    assert rows(got) == rows(reports.employee_report(role_tables(spark, SF_SMALL), "v3", top_n=5))


def test_columns_under_other_names_and_extra_columns(spark, names):
    table = spark.table(names["rules"]).withColumnRenamed("Org6", "org code").selectExpr("*", "1 AS extra")
    table.createOrReplaceTempView(names["rules"])
    t = roster_tables(spark, names, {"rules": {"Org6": "org code"}})
    assert tuple(t.rules.columns) == ROLE_COLUMNS["rules"]
    assert rows(t.rules) == rows(role_tables(spark, SF_SMALL).rules)


def test_names_are_compared_as_the_session_does(spark, names):
    spark.table(names["status"]).toDF("esm_empstatusid", "ESM_EMPSTATUSDESC").createOrReplaceTempView(names["status"])
    assert roster_tables(spark, names).status.columns == list(ROLE_COLUMNS["status"])


def test_everything_missing_is_listed_at_once(spark, names):
    spark.table(names["breaks"]).drop("Applicable", "BreakInTime").createOrReplaceTempView(names["breaks"])
    wrong = {k: v for k, v in names.items() if k != "shifts"} | {"locations": "no_such_view"}
    with pytest.raises(ValueError) as error:
        roster_tables(spark, wrong, {"status": {"Nothing": "x"}})
    said = str(error.value)
    assert "shifts: no table named" in said and "locations: no table or view no_such_view" in said
    assert "no column Applicable, BreakInTime" in said and "status: Nothing is no column of this role" in said


def test_unknown_roles(spark, names):
    with pytest.raises(ValueError, match="no such role: staff"):
        roster_tables(spark, names | {"staff": "named_roster"})


def test_views_are_read_lazily_and_pruned(spark, names):
    plan = roster_tables(spark, names).roster.select("EmpCode")._jdf.queryExecution().optimizedPlan().toString()
    assert "user_id" in plan and "props" not in plan.split("Relation")[0]
