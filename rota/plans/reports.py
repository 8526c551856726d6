"""The employee report: one document per employee, five variants.

Plan shape (any variant):

1. Driving set: employees x status (inner; the status dimension is small and
   AQE broadcasts it when measured small), left-semi against the distinct
   roster employees (EXISTS), optionally top-N by employee code.
2. Roster and mapping, restricted to those employees, then reduced; each
   computed once and cut with a checkpoint.
3. Branches, each reduced to one row per employee with partial aggregation:
   access flags, shift details, location details, IP allow-list.
4. One-to-one left joins on the employee key, JSON text at the edge; cut, ORDER BY.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rota.operators.access import (
    access_flags, allow_list, attach_flags, attach_global_flags, first_owners_with, owners_with,
    rule_lookup,
)
from rota.operators.documents import (
    attach, child_array, detail_object, keyed_elements, to_json_columns,
)
from rota.operators.intervals import change_blocks, daily_ranges, restrict_owners
from rota.operators.summaries import (
    BREAK_FIELDS, ROSTER_FIELDS, location_details, location_pairs, location_summary_array, roster_daily, shift_summary,
)
from rota.session import cut_lineage
from rota.sources.roles import RosterTables

# Identity columns of the report, in output order.
IDENTITY = ("ed_Salutation", "ed_firstname", "ed_MiddleName", "ed_lastname", "ed_empid",
            "ED_Status", "ESM_EmpStatusDesc")
FLAGS = ("IPCheckEnabled", "LocationCheckEnabled", "IPCheckEnabledOnMobile", "PunchIn", "PunchOut")
DOCUMENT_COLUMNS = ("ShiftDetails", "LocationDetails", "IPRange")
SHIFT_MASTER_HEAD = ("ShiftName",)
SHIFT_MASTER_TAIL = ("InTime", "OutTime", "TotalMinutes", "SwipesSeperatorParam",
                     "ISWorkBtwnShifttime", "IsBreakApplicable", "IsNightShiftApplicable",
                     "IsActive", "AutoShift", "ShiftAllowance")
# The organisation whose rules the reports read.
RULE_ORG = "23215"
LOCATION_DETAIL_FIELDS = ("georange", "rangeinkm", "Latitude", "Longitude", "LocationAlias",
                          "DateRanges")


@dataclass(frozen=True)
class Variant:
    top_n: int | None
    flags: str             # 'global' (one row for everybody) or 'owner'
    shift_encoding: str    # 'flat' array, or {ShiftID, ShiftDetails} with 'text' / 'nested' details
    breaks: str | None     # 'inner', 'left' or None
    pre_post: str          # 'roster' (MIN over roster) or 'rules' (rule lookup)
    shift_span: bool       # ShiftStart/ShiftEnd in the shift object
    location: str          # 'summary' or 'details' (with resolved DateRanges)


VARIANTS = {
    "v1": Variant(10, "global", "flat", "inner", "roster", True, "summary"),
    "v2": Variant(100, "owner", "text", "left", "roster", True, "summary"),
    "v3": Variant(10, "owner", "nested", "left", "roster", True, "summary"),
    "v4": Variant(10, "owner", "text", "left", "rules", False, "summary"),
    "v5": Variant(10, "owner", "nested", None, "roster", True, "details"),
}

_DEFAULT = object()


def driving_set(t: RosterTables, top_n: int | None = None,
                roster: DataFrame | None = None) -> DataFrame:
    """Employees with a status row and at least one roster row; the first
    ``top_n`` by employee code when given. ``roster`` may be the reduced
    roster (``roster_daily``) to share its scan."""
    emp = t.employees.join(t.status, F.col("ED_Status") == F.col("ESM_EmpStatusID"), "inner")
    facts = t.roster if roster is None else roster
    if top_n is None:
        emp = owners_with(emp, facts, "ed_empcode", "EmpCode")
    else:
        emp = first_owners_with(emp, facts, "ed_empcode", "EmpCode", top_n)
    return emp.select(F.col("ed_empcode").alias("EmpCode"), *IDENTITY)


def shift_elements(t: RosterTables, v: Variant, roster: DataFrame,
                   weight: str | None = None) -> DataFrame:
    """(EmpCode, ShiftDetails array) for one variant. ``roster`` is raw roster
    rows, or ``roster_daily`` output with its row-count column as ``weight``."""
    breaks = t.breaks if v.breaks else None
    summary = shift_summary(roster, t.shifts, breaks, v.breaks)
    master_fields = [*SHIFT_MASTER_HEAD, *(("ShiftStart", "ShiftEnd") if v.shift_span else ()),
                     *SHIFT_MASTER_TAIL]
    break_fields = list(BREAK_FIELDS) if v.breaks else []

    if v.shift_encoding == "flat":
        blocks = change_blocks(roster, "EmpCode", "Date", "ShiftID", weight=weight)
        summary = summary.drop("ShiftStart", "ShiftEnd").join(
            blocks, ["EmpCode", "ShiftID"], "inner")
        fields = ["ShiftID", *ROSTER_FIELDS, *master_fields, *break_fields]
        return child_array(summary, "EmpCode", fields, "ShiftDetails")

    if v.pre_post == "rules":
        rules = rule_lookup(t.rules, RULE_ORG, key="ShiftID")
        summary = summary.drop("PreTime", "PostTime").join(rules, "ShiftID", "left")
    ranges = child_array(daily_ranges(roster, "EmpCode", "Date", "ShiftID"),
                         ["EmpCode", "ShiftID"], ["RangeStart", "RangeEnd"], "ShiftRanges")
    summary = summary.join(ranges, ["EmpCode", "ShiftID"], "left")
    fields = [*ROSTER_FIELDS, *master_fields, *break_fields, "ShiftRanges"]
    details = summary.select("EmpCode", "ShiftID",
                             detail_object(fields, v.shift_encoding, summary.schema).alias("ShiftDetails"))
    return keyed_elements(roster, details, "EmpCode", "ShiftID", "ShiftDetails", "ShiftDetails")


def location_elements(t: RosterTables, v: Variant, mapping: DataFrame,
                      intervals: DataFrame | None = None,
                      owners: DataFrame | None = None, ranges_method: str = "segments",
                      reduced: bool = False) -> DataFrame:
    """(EmployeeCode, LocationDetails array) for one variant. ``mapping`` may
    be raw rows or ``location_pairs`` (``reduced``); v5 resolves ``intervals`` (default:
    ``mapping``) restricted to ``owners``."""
    if v.location == "summary":
        return location_summary_array(mapping, t.locations, reduced=reduced)
    det = location_details(mapping, t.locations, intervals=intervals, owners=owners,
                           method=ranges_method, reduced=reduced)
    det = det.select("EmployeeCode", "LocationID",
                     detail_object(LOCATION_DETAIL_FIELDS, "nested").alias("LocationDetails"))
    return keyed_elements(mapping, det, "EmployeeCode", "LocationID", "LocationDetails",
                          "LocationDetails")


def employee_report(t: RosterTables, variant: str | Variant = "v3", top_n=_DEFAULT,
                    output: str = "json", ordered: bool = True,
                    ranges_method: str = "segments") -> DataFrame:
    """One document row per employee.

    ``variant``: 'v1' .. 'v5' or a ``Variant``. ``top_n``: defaults to the
    variant's; ``None`` reports every employee. ``output``: 'json' gives JSON
    text columns, 'struct' keeps arrays/structs (for writing to parquet).
    ``ranges_method``: how v5 resolves location intervals ('days' or
    'segments' for long / open-ended intervals; same result).

    One plan for every N: the driving employees come first; the roster and the
    mapping are restricted to them by a left-semi join and then reduced. Each
    of the three is computed once and cut with ``checkpoint()`` in
    ``spark.checkpoint.dir`` (three jobs, run while the report is built), so the
    branches share them and lost executors cost no recomputation. Partition
    counts and join strategies are left to AQE. With ``ordered`` the finished
    documents are cut once more before the sort: finding the sort's range bounds
    reads its input twice, and so reads documents instead of assembling them again.
    """
    v = VARIANTS[variant] if isinstance(variant, str) else variant
    n = v.top_n if top_n is _DEFAULT else top_n

    driving = cut_lineage(driving_set(t, n))
    owners = driving.select("EmpCode")
    roster = cut_lineage(roster_daily(restrict_owners(t.roster, "EmpCode", owners)))
    raw_mapping = restrict_owners(t.mapping, "EmployeeCode", owners)
    mapping = cut_lineage(location_pairs(raw_mapping))
    intervals = None
    if v.location == "details":
        # Read by both halves of the segment form, so computed once as well.
        intervals = cut_lineage(raw_mapping.select("EmployeeCode", "LocationID", "FromDate", "ToDate").distinct())

    if v.flags == "global":
        doc = attach_global_flags(driving, t.mapping, t.locations)
    else:
        doc = attach_flags(driving, access_flags(mapping, t.locations, reduced=True), "EmpCode")

    doc = attach(doc, shift_elements(t, v, roster, weight="_rows"), "EmpCode", "EmpCode",
                 ["ShiftDetails"])
    doc = attach(doc, location_elements(t, v, mapping, intervals=intervals,
                                        ranges_method=ranges_method, reduced=True),
                 "EmpCode", "EmployeeCode", ["LocationDetails"])
    doc = attach(doc, allow_list(t.ip_ranges, mapping, t.locations), "EmpCode", "EmployeeCode",
                 ["IPRange"])
    doc = doc.select("EmpCode", *IDENTITY, *FLAGS, *DOCUMENT_COLUMNS)
    if output == "json":
        doc = to_json_columns(doc, DOCUMENT_COLUMNS)
    elif output != "struct":
        raise ValueError("output must be 'json' or 'struct'")
    return cut_lineage(doc).orderBy("EmpCode") if ordered else doc
