"""Registered queries: one per operator or report, each (spark, sf_dir) -> DataFrame.

Every query reads the supplied tables through the role views, over whole
tables; the only limits are the report variants' own top-N (the feature of
those reports), each also registered without it (``*_all``).
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rota.operators import access, intervals, summaries
from rota.functions.columns import refused_casts, whole_number
from rota.operators.documents import to_json_columns
from rota.plans import reports
from rota.session import checkpoint_dir, cut_lineage
from rota.sources.roles import ROLE_COLUMNS, RosterTables, role_tables, roster_tables, roster_view
from rota.sources.sinks import write_documents
from rota.sources.tables import read_table

Query = Callable[[SparkSession, str], DataFrame]


def _q(fn: Callable[[RosterTables], DataFrame]) -> Query:
    return lambda spark, sf_dir: fn(role_tables(spark, sf_dir))


def employee_status_topn(t: RosterTables, top_n: int = 10) -> DataFrame:
    joined = t.employees.join(t.status, F.col("ED_Status") == F.col("ESM_EmpStatusID"), "inner")
    return (joined.select(F.col("ed_empcode").alias("EmpCode"), *reports.IDENTITY)
            .orderBy("EmpCode").limit(top_n))


def active_employees_exists(t: RosterTables) -> DataFrame:
    return (access.owners_with(t.employees, t.roster, "ed_empcode", "EmpCode")
            .select(F.col("ed_empcode").alias("EmpCode"), "ed_firstname", "ED_Status"))


def allow_list_in(t: RosterTables) -> DataFrame:
    return to_json_columns(access.allow_list(t.ip_ranges, t.mapping, t.locations), ["IPRange"])


def resolve_daily_shift(t: RosterTables) -> DataFrame:
    return intervals.resolve_daily(t.roster, "EmpCode", "Date", "ShiftID")


def first_value_window(t: RosterTables) -> DataFrame:
    return intervals.first_value_daily(t.roster, "EmpCode", "Date", "ShiftID")


def _marks(t: RosterTables) -> DataFrame:
    daily = intervals.resolve_daily(t.roster, "EmpCode", "Date", "ShiftID")
    return intervals.island_marks(daily, ["EmpCode", "ShiftID"], "Date")


def shift_change_marks(t: RosterTables) -> DataFrame:
    return _marks(t).select("EmpCode", "ShiftID", "Date", "ShiftChange")


def shift_island_numbers(t: RosterTables) -> DataFrame:
    return _marks(t).select("EmpCode", "ShiftID", "Date", "ShiftGroup")


def shift_ranges(t: RosterTables) -> DataFrame:
    return intervals.daily_ranges(t.roster, "EmpCode", "Date", "ShiftID")


def shift_ranges_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``shift_ranges`` with days that carry a time of day."""
    events = read_table(spark, sf_dir, "events")
    stamped = roster_view(events, day=F.col("ts")).select("EmpCode", "ShiftID", "Date")
    return intervals.daily_ranges(stamped, "EmpCode", "Date", "ShiftID")


def shift_blocks(t: RosterTables) -> DataFrame:
    return intervals.shift_blocks(t.roster, ["EmpCode", "ShiftID"], "Date")


def shift_span(t: RosterTables) -> DataFrame:
    return intervals.span(t.roster, ["EmpCode", "ShiftID"], "Date")


def change_blocks(t: RosterTables) -> DataFrame:
    return intervals.change_blocks(t.roster, "EmpCode", "Date", "ShiftID")


def expand_days(t: RosterTables) -> DataFrame:
    return intervals.expand_days(t.mapping, "FromDate", "ToDate",
                                 keep=["EmployeeCode", "LocationID"])


def resolve_overlaps(t: RosterTables) -> DataFrame:
    return intervals.resolve_overlaps(t.mapping, "EmployeeCode", "FromDate", "ToDate",
                                      "LocationID")


def location_ranges(t: RosterTables) -> DataFrame:
    return intervals.resolved_ranges(t.mapping, "EmployeeCode", "FromDate", "ToDate",
                                     "LocationID")


def resolve_overlaps_pieces(t: RosterTables) -> DataFrame:
    """``resolve_overlaps`` by pieces, expanded to days at the end."""
    pieces = intervals.overlap_pieces(t.mapping, "EmployeeCode", "FromDate", "ToDate", "LocationID")
    return intervals.expand_days(pieces, "PieceStart", "PieceEnd")


def location_ranges_days(t: RosterTables) -> DataFrame:
    return intervals.resolved_ranges(t.mapping, "EmployeeCode", "FromDate", "ToDate",
                                     "LocationID", method="days")


def long_assignments(t: RosterTables, max_days: int = 30) -> DataFrame:
    """Assignments that a guard of ``max_days`` keeps from being expanded."""
    _, rejected = intervals.split_by_length(t.mapping, "FromDate", "ToDate", max_days)
    return rejected.select("EmployeeCode", "LocationID", "FromDate", "ToDate", "Days")


def _dirty_mapping(t: RosterTables) -> DataFrame:
    # rangeinkm as text, with some values that are no whole number.
    text = F.col("rangeinkm").cast("string")
    odd = F.when(F.col("georange") % 19 == 0, F.concat(text, F.lit(".5"))).when(F.col("georange") % 23 == 0, "n/a")
    return t.mapping.withColumn("rangeinkm", F.coalesce(odd, text))


def dirty_ranges(t: RosterTables) -> DataFrame:
    """MAX of what casts to INT, per (owner, location)."""
    return _dirty_mapping(t).groupBy("EmployeeCode", "LocationID").agg(
        F.max(whole_number("rangeinkm")).alias("rangeinkm"))


def dirty_ranges_refused(t: RosterTables) -> DataFrame:
    return refused_casts(_dirty_mapping(t), ["rangeinkm"])


def doc_locations_datetime(t: RosterTables) -> DataFrame:
    """Location objects whose bounds carry a time of day, some a part of a second."""
    def timed(day: str, hours, seconds):
        return F.col(day).cast("timestamp_ntz") + F.make_dt_interval(hours=hours, secs=seconds)
    k = F.col("georange")
    stamped = t.mapping.withColumns({
        "FromDate": timed("FromDate", k % 24, F.lit(0.0).cast("decimal(18,6)")),
        "ToDate": timed("ToDate", F.lit(18), F.when(k % 4 == 0, 0.25).otherwise(0.0).cast("decimal(18,6)"))})
    found = summaries.location_summary_array(stamped, t.locations)
    return to_json_columns(found, ["LocationDetails"])


def rule_lookup_collated(t: RosterTables) -> DataFrame:
    """Rules whose keys and names are written in mixed case, read without regard to it;
    one row per key, under its lower-case name."""
    odd = F.length("RuleItemValue") % 2 == 0
    mixed = {c: F.when(odd, F.upper(c)).otherwise(F.col(c))
             for c in ("ShiftID", "RuleRelatedTo", "RuleConfigAttrItemName")}
    rules = access.collated(t.rules.withColumns(mixed), list(mixed))
    found = access.rule_lookup(rules, reports.RULE_ORG)
    return found.withColumn("ShiftID", F.collate(F.lower("ShiftID"), "UTF8_BINARY"))


def allow_list_shared(t: RosterTables) -> DataFrame:
    """``allow_list`` from its factorised form."""
    owners, lists = access.allow_list_sets(t.ip_ranges, t.mapping, t.locations)
    return to_json_columns(access.allow_list_of(owners, lists), ["IPRange"])


def rule_lookup_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules read by name, from a view with a column called otherwise."""
    t = role_tables(spark, sf_dir)
    names = {role: f"rota_{role}" for role in ROLE_COLUMNS}
    for role, name in names.items():
        table = getattr(t, role)
        if role == "rules":
            table = table.withColumnRenamed("Org6", "OrgCode")
        table.createOrReplaceTempView(name)
    return rule_lookup(roster_tables(spark, names, {"rules": {"Org6": "OrgCode"}}))


def written_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The v3 report of everybody, written as JSON documents and read back."""
    report = reports.employee_report(role_tables(spark, sf_dir), "v3", top_n=None, ordered=False)
    path = f"{checkpoint_dir(spark)}/written-report-{uuid4().hex}"
    write_documents(report, path, "json")
    return spark.read.schema(report.schema).json(path)


def location_ranges_segments(t: RosterTables) -> DataFrame:
    return intervals.resolved_ranges(t.mapping, "EmployeeCode", "FromDate", "ToDate",
                                     "LocationID", method="segments")


def access_flags(t: RosterTables) -> DataFrame:
    emp = t.employees.select(F.col("ed_empcode").alias("EmpCode"))
    return access.attach_flags(emp, access.access_flags(t.mapping, t.locations), "EmpCode")


def access_flags_global(t: RosterTables) -> DataFrame:
    emp = t.employees.select(F.col("ed_empcode").alias("EmpCode"))
    return access.attach_global_flags(emp, t.mapping, t.locations)


def rule_lookup(t: RosterTables) -> DataFrame:
    return access.rule_lookup(t.rules, reports.RULE_ORG)


def location_summary(t: RosterTables) -> DataFrame:
    return summaries.location_summary(t.mapping, t.locations)


def location_details(t: RosterTables) -> DataFrame:
    v5 = reports.VARIANTS["v5"]
    pairs = cut_lineage(summaries.location_pairs(t.mapping))
    return to_json_columns(reports.location_elements(
        t, v5, pairs, intervals=t.mapping, reduced=True), ["LocationDetails"])


def _shift_summary(how: str) -> Callable[[RosterTables], DataFrame]:
    return lambda t: summaries.shift_summary(t.roster, t.shifts, t.breaks, how)


def _doc(variant: str) -> Callable[[RosterTables], DataFrame]:
    def build(t: RosterTables) -> DataFrame:
        v = reports.VARIANTS[variant]
        return to_json_columns(reports.shift_elements(t, v, t.roster), ["ShiftDetails"])
    return build


def _report(variant: str, top_n) -> Callable[[RosterTables], DataFrame]:
    if top_n == "default":
        return lambda t: reports.employee_report(t, variant)
    return lambda t: reports.employee_report(t, variant, top_n=top_n)


def queries() -> dict[str, Query]:
    q: dict[str, Query] = {
        "employee_status_topn": _q(employee_status_topn),
        "active_employees_exists": _q(active_employees_exists),
        "allow_list_in": _q(allow_list_in),
        "resolve_daily_shift": _q(resolve_daily_shift),
        "first_value_window": _q(first_value_window),
        "shift_change_marks": _q(shift_change_marks),
        "shift_island_numbers": _q(shift_island_numbers),
        "shift_ranges": _q(shift_ranges),
        "shift_blocks": _q(shift_blocks),
        "shift_span": _q(shift_span),
        "change_blocks": _q(change_blocks),
        "expand_days": _q(expand_days),
        "resolve_overlaps": _q(resolve_overlaps),
        "location_ranges": _q(location_ranges),
        "location_ranges_segments": _q(location_ranges_segments),
        "location_ranges_days": _q(location_ranges_days),
        "resolve_overlaps_pieces": _q(resolve_overlaps_pieces),
        "rule_lookup_collated": _q(rule_lookup_collated),
        "allow_list_shared": _q(allow_list_shared),
        "long_assignments": _q(long_assignments),
        "dirty_ranges": _q(dirty_ranges),
        "dirty_ranges_refused": _q(dirty_ranges_refused),
        "doc_locations_datetime": _q(doc_locations_datetime),
        "access_flags": _q(access_flags),
        "access_flags_global": _q(access_flags_global),
        "rule_lookup": _q(rule_lookup),
        "location_summary": _q(location_summary),
        "location_details": _q(location_details),
        "shift_summary_inner": _q(_shift_summary("inner")),
        "shift_summary_left": _q(_shift_summary("left")),
        "doc_flat": _q(_doc("v1")),
        "doc_text": _q(_doc("v2")),
        "doc_nested": _q(_doc("v3")),
    }
    q["shift_ranges_timestamps"] = shift_ranges_timestamps
    q["rule_lookup_view"] = rule_lookup_view
    q["written_report"] = written_report
    for v in reports.VARIANTS:
        q[f"report_{v}"] = _q(_report(v, "default"))
        q[f"report_{v}_all"] = _q(_report(v, None))
    return q
