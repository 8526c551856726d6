"""Per-key summaries: shift summary at (employee, shift) grain and location
summaries at (employee, location) grain.

The reports aggregate MIN/MAX over a join product (roster x shift master x
breaks x blocks). MIN and MAX ignore duplicates, so the product is replaced
by one aggregate per factor, joined afterwards at the group grain; the inner
or left character of each join is kept, so the same groups survive.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rota.functions.columns import bit_and, bit_or, sorted_array
from rota.operators.access import mapped_locations
from rota.operators.intervals import resolved_ranges

# Output fields and their order, as in the shift element.
ROSTER_FIELDS = ("AttMode", "DiffIN", "DiffOUT", "TotalworkedMinutes", "RegIN", "RegOut",
                 "PreTime", "PostTime", "FromMin", "ToMin")
BREAK_FIELDS = ("BreakInTime", "BreakOutTime", "TotalBreakMinutes", "Applicable")
LOCATION_FIELDS = ("georange", "rangeinkm", "Latitude", "Longitude", "FromDate", "ToDate",
                   "LocationAlias")


def roster_daily(roster: DataFrame, emp: str = "EmpCode", shift: str = "ShiftID",
                 day: str = "Date", fields: Sequence[str] = ROSTER_FIELDS,
                 rows: str = "_rows") -> DataFrame:
    """The roster reduced to one row per (employee, shift, day): MIN of each
    field and the row count. Every report branch that reads the roster can
    read this instead (MIN/MAX are unchanged by pre-aggregation, the count
    keeps what LEAD/LAG needs), so the roster is scanned and shuffled once and
    a hot employee is collapsed map-side to its distinct (shift, day) pairs."""
    return roster.groupBy(emp, shift, day).agg(
        *[F.min(c).alias(c) for c in fields], F.count(F.lit(1)).alias(rows))


def roster_aggregates(roster: DataFrame, emp: str = "EmpCode", shift: str = "ShiftID",
                      day: str = "Date", fields: Sequence[str] = ROSTER_FIELDS) -> DataFrame:
    """MIN of each roster field and the first/last day per (employee, shift).
    Accepts raw roster rows or ``roster_daily`` output."""
    return roster.groupBy(emp, shift).agg(
        *[F.min(c).alias(c) for c in fields],
        F.min(day).alias("ShiftStart"), F.max(day).alias("ShiftEnd"))


def master_aggregates(shifts: DataFrame, key: str = "ShiftId") -> DataFrame:
    """Shift master folded to one row per shift id (MIN/MAX, bits via TINYINT)."""
    return shifts.groupBy(key).agg(
        F.min("ShiftName").alias("ShiftName"),
        F.min("InTime").alias("InTime"),
        F.max("OutTime").alias("OutTime"),
        F.max("TotalMinutes").alias("TotalMinutes"),
        F.min("SwipesSeperatorParam").alias("SwipesSeperatorParam"),
        bit_and("ISWorkBtwnShifttime").alias("ISWorkBtwnShifttime"),
        bit_and("IsBreakApplicable").alias("IsBreakApplicable"),
        bit_and("IsNightShiftApplicable").alias("IsNightShiftApplicable"),
        bit_and("IsActive").alias("IsActive"),
        F.min("AutoShift").alias("AutoShift"),
        bit_and("ShiftAllowance").alias("ShiftAllowance"),
    )


def break_aggregates(breaks: DataFrame, key: str = "ShiftId") -> DataFrame:
    """Breaks folded to one row per shift id."""
    return breaks.groupBy(key).agg(
        F.min("BreakInTime").alias("BreakInTime"),
        F.max("BreakOutTime").alias("BreakOutTime"),
        F.max("TotalBreakMinutes").alias("TotalBreakMinutes"),
        bit_and("Applicable").alias("Applicable"),
    )


def shift_summary(roster: DataFrame, shifts: DataFrame, breaks: DataFrame | None = None,
                  breaks_join: str | None = "left", emp: str = "EmpCode",
                  shift: str = "ShiftID", day: str = "Date",
                  master_key: str = "ShiftId") -> DataFrame:
    """One row per (employee, shift) that has a shift master row.

    ``breaks_join``: ``'inner'`` drops shifts without a break row, ``'left'``
    keeps them with NULL break fields, ``None`` leaves breaks out. Columns:
    emp, shift, roster fields, ShiftStart, ShiftEnd, master fields [, break fields].
    """
    ro = roster_aggregates(roster, emp, shift, day)
    master = master_aggregates(shifts, master_key).withColumnRenamed(master_key, shift)
    out = ro.join(master, shift, "inner")
    if breaks is not None and breaks_join is not None:
        brk = break_aggregates(breaks, master_key).withColumnRenamed(master_key, shift)
        out = out.join(brk, shift, breaks_join)
    return out


def location_pairs(mapping: DataFrame, owner: str = "EmployeeCode",
                   location: str = "LocationID") -> DataFrame:
    """The mapping reduced to one row per (owner, location): MIN georange,
    MAX rangeinkm (as INT), MIN FromDate, MIN ToDate and the punch bits as
    MAX INT. Flags, location summaries, v5 attributes and the IP allow-list
    give the same results on this as on the raw rows, so the mapping is
    aggregated once (map-side first) and shared by those branches."""
    return mapping.groupBy(owner, location).agg(
        F.min("georange").alias("georange"),
        bit_or("rangeinkm").alias("rangeinkm"),
        F.min("FromDate").alias("FromDate"),
        F.min("ToDate").alias("ToDate"),
        bit_or("PunchIn").alias("PunchIn"),
        bit_or("PunchOut").alias("PunchOut"),
    )


def _mapping_fields(mapping: DataFrame, owner: str, location: str, fields: Sequence[str]) -> DataFrame:
    """``fields`` of the mapping reduced to one row per (owner, location)."""
    reduce = {"rangeinkm": bit_or}
    return mapping.groupBy(owner, location).agg(*[reduce.get(f, F.min)(f).alias(f) for f in fields])


def location_summary(mapping: DataFrame, locations: DataFrame, owner: str = "EmployeeCode",
                     location: str = "LocationID", location_id: str = "ID",
                     reduced: bool = False) -> DataFrame:
    """Per (owner, location) with a master row: MIN georange, MAX rangeinkm,
    MIN coordinates, MIN FromDate, MIN ToDate (the earliest end, as in the
    reports) and MIN alias. The mapping is reduced to one row per (owner,
    location) before it meets the master, unless it is already (``reduced``)."""
    pairs = mapping if reduced else _mapping_fields(
        mapping, owner, location, ("georange", "rangeinkm", "FromDate", "ToDate"))
    joined = mapped_locations(pairs, locations, owner, location, location_id,
                              ("Latitude", "Longitude", "LocationAlias"))
    return joined.groupBy(owner, location).agg(
        F.min("georange").alias("georange"),
        bit_or("rangeinkm").alias("rangeinkm"),
        F.min("Latitude").alias("Latitude"),
        F.min("Longitude").alias("Longitude"),
        F.min("FromDate").alias("FromDate"),
        F.min("ToDate").alias("ToDate"),
        F.min("LocationAlias").alias("LocationAlias"),
    )


def location_summary_array(mapping: DataFrame, locations: DataFrame,
                           owner: str = "EmployeeCode", location: str = "LocationID",
                           location_id: str = "ID", out: str = "LocationDetails",
                           reduced: bool = False) -> DataFrame:
    """``location_summary`` as one array per owner sorted by location id."""
    per_loc = location_summary(mapping, locations, owner, location, location_id, reduced)
    return per_loc.groupBy(owner).agg(
        sorted_array(location, *LOCATION_FIELDS).alias(out))


def location_details(mapping: DataFrame, locations: DataFrame, owner: str = "EmployeeCode",
                     location: str = "LocationID", location_id: str = "ID",
                     start: str = "FromDate", end: str = "ToDate",
                     intervals: DataFrame | None = None,
                     owners: DataFrame | None = None, method: str = "segments",
                     reduced: bool = False) -> DataFrame:
    """Per (owner, location) with a master row: MIN georange, MAX rangeinkm,
    MIN coordinates, MIN alias and ``DateRanges`` - the overlap-resolved date
    ranges the location wins (absent when it wins no day).

    ``mapping`` may be raw rows or ``location_pairs``; ``intervals`` are the
    raw interval rows to expand (default: ``mapping``). ``owners`` (one column,
    the owner key) restricts the intervals before they are resolved. ``method``: see
    ``resolved_ranges``; ``reduced``: see ``location_summary``."""
    pairs = mapping if reduced else _mapping_fields(mapping, owner, location, ("georange", "rangeinkm"))
    joined = mapped_locations(pairs, locations, owner, location, location_id,
                              ("Latitude", "Longitude", "LocationAlias"))
    attrs = joined.groupBy(owner, location).agg(
        F.min("georange").alias("georange"),
        bit_or("rangeinkm").alias("rangeinkm"),
        F.min("Latitude").alias("Latitude"),
        F.min("Longitude").alias("Longitude"),
        F.min("LocationAlias").alias("LocationAlias"),
    )
    ranges = (resolved_ranges(intervals if intervals is not None else mapping,
                              owner, start, end, location, owners=owners, method=method)
              .groupBy(owner, location)
              .agg(sorted_array("RangeStart", "RangeEnd").alias("DateRanges")))
    return attrs.join(ranges, [owner, location], "left")
