"""Role views: the nine relations the reports read.

The reports run on workforce tables (employees, status dimension, roster,
shift master, shift breaks, employee-location mapping, location master, IP
ranges, rule configuration). ``RosterTables`` carries one DataFrame per role,
with the column names the operators default to. Real deployments pass their own
tables; ``role_tables`` derives every role from the supplied test tables with
column derivations only (no row filters), so each role grows with the scale
factor of its source.

The same derivations are written as SQL views in ``tools.report_oracle``; keep
the two in step.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rota.sources.tables import read_table

# The shift codes of the test roster (the event types of `events`).
SHIFT_CODES = ("click", "view", "error", "purchase", "signup")


@dataclass(frozen=True)
class RosterTables:
    employees: DataFrame   # ed_empcode, ed_Salutation, ed_firstname, ed_MiddleName, ed_lastname, ed_empid, ED_Status
    status: DataFrame      # ESM_EmpStatusID, ESM_EmpStatusDesc
    roster: DataFrame      # EmpCode, ShiftID, Date, AttMode, DiffIN, DiffOUT, TotalworkedMinutes, RegIN, RegOut, PreTime, PostTime, FromMin, ToMin
    shifts: DataFrame      # ShiftId, ShiftName, InTime, OutTime, TotalMinutes, SwipesSeperatorParam, bits..., AutoShift
    breaks: DataFrame      # ShiftId, BreakInTime, BreakOutTime, TotalBreakMinutes, Applicable
    mapping: DataFrame     # EmployeeCode, LocationID, georange, rangeinkm, FromDate, ToDate, PunchIn, PunchOut
    locations: DataFrame   # ID, Latitude, Longitude, LocationAlias, IPCheckEnabled, LocationCheckEnabled, IPCheckEnabledOnMobile
    ip_ranges: DataFrame   # GeoConfigurationID, IPFrom, IPTo
    rules: DataFrame       # ShiftID, RuleItemValue, Org6, RuleRelatedTo, RuleConfigAttrItemName, RuleEndDate


# The columns that the operators read from each role.
ROLE_COLUMNS = {
    "employees": ("ed_empcode", "ed_Salutation", "ed_firstname", "ed_MiddleName", "ed_lastname", "ed_empid",
                  "ED_Status"),
    "status": ("ESM_EmpStatusID", "ESM_EmpStatusDesc"),
    "roster": ("EmpCode", "ShiftID", "Date", "AttMode", "DiffIN", "DiffOUT", "TotalworkedMinutes", "RegIN",
               "RegOut", "PreTime", "PostTime", "FromMin", "ToMin"),
    "shifts": ("ShiftId", "ShiftName", "InTime", "OutTime", "TotalMinutes", "SwipesSeperatorParam",
               "ISWorkBtwnShifttime", "IsBreakApplicable", "IsNightShiftApplicable", "IsActive", "AutoShift",
               "ShiftAllowance"),
    "breaks": ("ShiftId", "BreakInTime", "BreakOutTime", "TotalBreakMinutes", "Applicable"),
    "mapping": ("EmployeeCode", "LocationID", "georange", "rangeinkm", "FromDate", "ToDate", "PunchIn", "PunchOut"),
    "locations": ("ID", "Latitude", "Longitude", "LocationAlias", "IPCheckEnabled", "LocationCheckEnabled",
                  "IPCheckEnabledOnMobile"),
    "ip_ranges": ("GeoConfigurationID", "IPFrom", "IPTo"),
    "rules": ("ShiftID", "RuleItemValue", "Org6", "RuleRelatedTo", "RuleConfigAttrItemName", "RuleEndDate"),
}


def roster_tables(spark: SparkSession, names: Mapping[str, str],
                  columns: Mapping[str, Mapping[str, str]] | None = None) -> RosterTables:
    """The nine roles from tables and views of the session's catalog.

    ``names``: role -> table or view name, with its schema if need be
    (``hr.roster``). ``columns``: role -> {column an operator reads: column of the table},
    for those named otherwise; names are compared as the session does. A role
    without a name, an unknown table or a missing column is an error that lists
    everything missing at once. Lazy: nothing is read, unused columns are not selected.
    """
    roles, columns = [f.name for f in fields(RosterTables)], columns or {}
    unknown = sorted({*names, *columns} - set(roles))
    if unknown:
        raise ValueError(f"no such role: {', '.join(unknown)}; roles are {', '.join(roles)}")
    exact = spark.conf.get("spark.sql.caseSensitive") == "true"
    found, wrong = {}, []
    for role in roles:
        if role not in names:
            wrong.append(f"{role}: no table named")
        elif not spark.catalog.tableExists(names[role]):
            wrong.append(f"{role}: no table or view {names[role]}")
        else:
            table, own = spark.table(names[role]), columns.get(role, {})
            have = {c if exact else c.lower() for c in table.columns}
            source = {c: own.get(c, c) for c in ROLE_COLUMNS[role]}
            strange = sorted(set(own) - set(source))
            missing = sorted(c for c in source.values() if (c if exact else c.lower()) not in have)
            wrong += [f"{role}: {c} is no column of this role" for c in strange]
            if missing:
                wrong.append(f"{role} ({names[role]}): no column {', '.join(missing)}")
            else:
                found[role] = table.select(*[F.col(f"`{c}`").alias(want) for want, c in source.items()])
    if wrong:
        raise ValueError("; ".join(wrong))
    return RosterTables(**found)


def _hhmmss(hour: Column, minute: str) -> Column:
    return F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(f":{minute}:00"))


def _shift_code(index: Column, codes: tuple[str, ...]) -> Column:
    expr = None
    for i, code in enumerate(codes):
        expr = F.when(index == i, code) if expr is None else expr.when(index == i, code)
    return expr


def employees_view(customer: DataFrame) -> DataFrame:
    # Status ids run 3..27 against a 25-row status dimension, so some
    # employees have no status row and drop out of the inner join.
    k = F.col("c_custkey")
    return customer.select(
        F.col("c_custkey").alias("ed_empcode"),
        F.when(k % 3 != 0, F.when(k % 3 == 1, "Ms").otherwise("Mr")).alias("ed_Salutation"),
        F.col("c_name").alias("ed_firstname"),
        F.when(k % 4 != 0, F.concat(F.lit("M"), (k % 7).cast("string"))).alias("ed_MiddleName"),
        F.col("c_mktsegment").alias("ed_lastname"),
        F.col("c_custkey").alias("ed_empid"),
        (F.col("c_nationkey") + 3).alias("ED_Status"),
    )


def status_view(nation: DataFrame) -> DataFrame:
    return nation.select(
        F.col("n_nationkey").alias("ESM_EmpStatusID"),
        F.col("n_name").alias("ESM_EmpStatusDesc"),
    )


def roster_view(events: DataFrame, day: Column | None = None) -> DataFrame:
    # ``day``: what Date is, by default the day of the event. Some rows have no shift, no swipe out and no end minute.
    eid = F.col("event_id")
    return events.select(
        F.col("user_id").alias("EmpCode"),
        F.when(eid % 41 != 0, F.col("event_type")).alias("ShiftID"),
        (F.col("ts").cast("date") if day is None else day).alias("Date"),
        F.col("props").alias("AttMode"),
        (eid % 60).cast("int").alias("DiffIN"),
        (eid % 7).cast("int").alias("DiffOUT"),
        (eid % 480).cast("int").alias("TotalworkedMinutes"),
        F.date_format("ts", "HH:mm:ss").alias("RegIN"),
        F.when(eid % 5 != 0, _hhmmss((eid % 24).cast("int"), "15")).alias("RegOut"),
        (eid % 15).cast("int").alias("PreTime"),
        (eid % 20).cast("int").alias("PostTime"),
        (eid % 30).cast("int").alias("FromMin"),
        F.when(eid % 6 != 0, (eid % 45).cast("int")).alias("ToMin"),
    )


def shifts_view(nation: DataFrame) -> DataFrame:
    # Region 4 maps to a second 'click' group; 'signup' has no master row.
    n = F.col("n_nationkey")
    code = _shift_code(F.col("n_regionkey"), ("click", "view", "error", "purchase", "click"))
    return nation.select(
        code.alias("ShiftId"),
        F.col("n_name").alias("ShiftName"),
        _hhmmss(n % 24, "00").alias("InTime"),
        _hhmmss((n + 9) % 24, "30").alias("OutTime"),
        (n + 480).cast("int").alias("TotalMinutes"),
        (n % 3).cast("string").alias("SwipesSeperatorParam"),
        (n % 2 == 0).alias("ISWorkBtwnShifttime"),
        (n % 3 != 0).alias("IsBreakApplicable"),
        (n >= 15).alias("IsNightShiftApplicable"),
        (n != 7).alias("IsActive"),
        F.when(n % 4 == 0, "Y").otherwise("N").alias("AutoShift"),
        (n % 5 == 1).alias("ShiftAllowance"),
    )


def breaks_view(region: DataFrame) -> DataFrame:
    # Two break rows for 'view', none for 'error'; the 'signup' break has no
    # master row and can never be reached.
    r = F.col("r_regionkey")
    code = _shift_code(r, ("view", "view", "click", "purchase", "signup"))
    return region.select(
        code.alias("ShiftId"),
        _hhmmss(r + 12, "00").alias("BreakInTime"),
        _hhmmss(r + 12, "45").alias("BreakOutTime"),
        (r * 5 + 30).cast("int").alias("TotalBreakMinutes"),
        (r % 2 == 0).alias("Applicable"),
    )


def mapping_view(orders: DataFrame) -> DataFrame:
    # Interval length o_orderkey % 64 - 1 days: 0 gives a reversed interval;
    # pending orders get an open (NULL) end. An employee has up to 12 locations
    # at every scale; their ids range over all suppliers, and those beyond
    # both ends of the supplier ids have no master row.
    k = F.col("o_orderkey")
    start = F.col("o_orderdate").cast("date")
    return orders.select(
        F.col("o_custkey").alias("EmployeeCode"),
        (F.floor(F.col("o_custkey") / 15) + k % 12 - 2).cast("int").alias("LocationID"),
        (k % 500).cast("int").alias("georange"),
        (k % 17).cast("int").alias("rangeinkm"),
        start.alias("FromDate"),
        F.when(F.col("o_orderstatus") != "P",
               F.date_add(start, (k % 64).cast("int") - 1)).alias("ToDate"),
        (k % 3 == 0).alias("PunchIn"),
        (k % 11 == 0).alias("PunchOut"),
    )


def locations_view(supplier: DataFrame) -> DataFrame:
    s = F.col("s_suppkey")
    return supplier.select(
        s.cast("int").alias("ID"),
        (F.col("s_nationkey") + 0.25).alias("Latitude"),
        (F.lit(24.5) - F.col("s_nationkey")).alias("Longitude"),
        F.col("s_name").alias("LocationAlias"),
        (s % 10 == 1).alias("IPCheckEnabled"),
        (s % 10).isin(2, 3).alias("LocationCheckEnabled"),
        (s % 10 == 4).alias("IPCheckEnabledOnMobile"),
    )


def ip_ranges_view(part: DataFrame) -> DataFrame:
    # About 20 rows for each location, at every scale.
    return part.select(
        F.floor(F.col("p_partkey") / 20).cast("int").alias("GeoConfigurationID"),
        F.col("p_name").alias("IPFrom"),
        F.col("p_brand").alias("IPTo"),
    )


def rules_view(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    return part.select(
        _shift_code(F.col("p_size") % 5, SHIFT_CODES).alias("ShiftID"),
        F.col("p_name").alias("RuleItemValue"),
        F.when(k % 4 == 0, "23215").otherwise((k % 4).cast("string")).alias("Org6"),
        F.when(k % 5 != 0, "Shift Properties").otherwise("Other").alias("RuleRelatedTo"),
        F.when(F.col("p_type") == "SMALL", "Pre Time Minutes")
         .when(F.col("p_type") == "LARGE", "Post Time")
         .otherwise(F.col("p_type")).alias("RuleConfigAttrItemName"),
        F.when(k % 3 != 0, F.to_date(F.lit("2030-12-31"))).alias("RuleEndDate"),
    )


def role_tables(spark: SparkSession, sf_dir: str) -> RosterTables:
    """All nine role views over the tables in ``sf_dir`` as they are now (lazy
    plans; files are listed on every call, so appended rows are seen)."""
    t = lambda name: read_table(spark, sf_dir, name)
    part = t("part")
    nation = t("nation")
    return RosterTables(
        employees=employees_view(t("customer")),
        status=status_view(nation),
        roster=roster_view(t("events")),
        shifts=shifts_view(nation),
        breaks=breaks_view(t("region")),
        mapping=mapping_view(t("orders")),
        locations=locations_view(t("supplier")),
        ip_ranges=ip_ranges_view(part),
        rules=rules_view(part),
    )
