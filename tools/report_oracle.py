"""DuckDB SQL for the report and operator queries: set-based, over all employees.

``VIEWS`` derives the roles from the supplied tables (in step with
``rota.sources.roles``); ``STEPS`` are shared intermediate tables; each query
selects from these. Runs of days are told by ``day - row_number``, neighbours in
a history by joins on a row number, documents by one aggregate per owner.
"""

from __future__ import annotations

VIEWS = """
employees AS (
  SELECT c_custkey AS ed_empcode, CASE c_custkey % 3 WHEN 1 THEN 'Ms' WHEN 2 THEN 'Mr' END AS ed_Salutation,
         c_name AS ed_firstname,
         CASE WHEN c_custkey % 4 <> 0 THEN 'M' || (c_custkey % 7) END AS ed_MiddleName,
         c_mktsegment AS ed_lastname,
         c_custkey AS ed_empid, c_nationkey + 3 AS ED_Status
  FROM customer),
status AS (
  SELECT n_nationkey AS ESM_EmpStatusID, n_name AS ESM_EmpStatusDesc FROM nation),
roster AS (
  SELECT user_id AS EmpCode, CASE WHEN event_id % 41 <> 0 THEN event_type END AS ShiftID,
         CAST(ts AS DATE) AS Date, props AS AttMode,
         CAST(event_id % 60 AS INTEGER) AS DiffIN, CAST(event_id % 7 AS INTEGER) AS DiffOUT,
         CAST(event_id % 480 AS INTEGER) AS TotalworkedMinutes, strftime(ts, '%H:%M:%S') AS RegIN,
         CASE WHEN event_id % 5 <> 0
              THEN lpad(CAST(event_id % 24 AS VARCHAR), 2, '0') || ':15:00' END AS RegOut,
         CAST(event_id % 15 AS INTEGER) AS PreTime,
         CAST(event_id % 20 AS INTEGER) AS PostTime, CAST(event_id % 30 AS INTEGER) AS FromMin,
         CASE WHEN event_id % 6 <> 0 THEN CAST(event_id % 45 AS INTEGER) END AS ToMin
  FROM events),
shifts AS (
  SELECT CASE n_regionkey WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error'
                          WHEN 3 THEN 'purchase' WHEN 4 THEN 'click' END AS ShiftId,
         n_name AS ShiftName,
         lpad(CAST(n_nationkey % 24 AS VARCHAR), 2, '0') || ':00:00' AS InTime,
         lpad(CAST((n_nationkey + 9) % 24 AS VARCHAR), 2, '0') || ':30:00' AS OutTime,
         CAST(n_nationkey + 480 AS INTEGER) AS TotalMinutes,
         CAST(n_nationkey % 3 AS VARCHAR) AS SwipesSeperatorParam,
         n_nationkey % 2 = 0 AS ISWorkBtwnShifttime, n_nationkey % 3 <> 0 AS IsBreakApplicable,
         n_nationkey >= 15 AS IsNightShiftApplicable, n_nationkey <> 7 AS IsActive,
         CASE WHEN n_nationkey % 4 = 0 THEN 'Y' ELSE 'N' END AS AutoShift,
         n_nationkey % 5 = 1 AS ShiftAllowance
  FROM nation),
breaks AS (
  SELECT CASE r_regionkey WHEN 0 THEN 'view' WHEN 1 THEN 'view' WHEN 2 THEN 'click'
                          WHEN 3 THEN 'purchase' WHEN 4 THEN 'signup' END AS ShiftId,
         lpad(CAST(r_regionkey + 12 AS VARCHAR), 2, '0') || ':00:00' AS BreakInTime,
         lpad(CAST(r_regionkey + 12 AS VARCHAR), 2, '0') || ':45:00' AS BreakOutTime,
         CAST(r_regionkey * 5 + 30 AS INTEGER) AS TotalBreakMinutes,
         r_regionkey % 2 = 0 AS Applicable
  FROM region),
mapping AS (
  SELECT o_custkey AS EmployeeCode, CAST(o_custkey // 15 + o_orderkey % 12 - 2 AS INTEGER) AS LocationID,
         CAST(o_orderkey % 500 AS INTEGER) AS georange, CAST(o_orderkey % 17 AS INTEGER) AS rangeinkm,
         CAST(o_orderdate AS DATE) AS FromDate,
         CASE WHEN o_orderstatus <> 'P'
              THEN CAST(o_orderdate AS DATE) + (CAST(o_orderkey % 64 AS INTEGER) - 1) END AS ToDate,
         o_orderkey % 3 = 0 AS PunchIn, o_orderkey % 11 = 0 AS PunchOut
  FROM orders),
locations AS (
  SELECT CAST(s_suppkey AS INTEGER) AS ID, CAST(s_nationkey + 0.25 AS DOUBLE) AS Latitude,
         CAST(24.5 - s_nationkey AS DOUBLE) AS Longitude,
         s_name AS LocationAlias, s_suppkey % 10 = 1 AS IPCheckEnabled,
         s_suppkey % 10 IN (2, 3) AS LocationCheckEnabled, s_suppkey % 10 = 4 AS IPCheckEnabledOnMobile
  FROM supplier),
ip_ranges AS (
  SELECT CAST(p_partkey // 20 AS INTEGER) AS GeoConfigurationID, p_name AS IPFrom, p_brand AS IPTo
  FROM part),
rules AS (
  SELECT CASE p_size % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error'
                         WHEN 3 THEN 'purchase' WHEN 4 THEN 'signup' END AS ShiftID,
         p_name AS RuleItemValue,
         CASE WHEN p_partkey % 4 = 0 THEN '23215' ELSE CAST(p_partkey % 4 AS VARCHAR) END AS Org6,
         CASE WHEN p_partkey % 5 <> 0 THEN 'Shift Properties' ELSE 'Other' END AS RuleRelatedTo,
         CASE WHEN p_type = 'SMALL' THEN 'Pre Time Minutes' WHEN p_type = 'LARGE' THEN 'Post Time'
              ELSE p_type END AS RuleConfigAttrItemName,
         CASE WHEN p_partkey % 3 <> 0 THEN DATE '2030-12-31' END AS RuleEndDate
  FROM part)
"""

def _runs(source: str, keys: str, day: str) -> str:
    """First and last day of each run of consecutive days per key."""
    return f"""SELECT {keys}, min({day}) AS RangeStart, max({day}) AS RangeEnd
  FROM (SELECT *, {day} - (row_number() OVER (PARTITION BY {keys} ORDER BY {day}))::INT AS run
        FROM {source})
  GROUP BY {keys}, run"""


STEPS = f"""
days AS (
  SELECT EmployeeCode, LocationID,
         unnest(generate_series(FromDate, ToDate, INTERVAL 1 DAY))::DATE AS SingleDate
  FROM mapping WHERE ToDate >= FromDate),
day_winner AS (
  SELECT EmployeeCode, SingleDate, max(LocationID) AS LocationID FROM days GROUP BY ALL),
location_runs AS (
  {_runs("day_winner", "EmployeeCode, LocationID", "SingleDate")}),
shift_day AS (SELECT EmpCode, Date, max(ShiftID) AS ShiftID FROM roster GROUP BY ALL),
shift_runs AS (
  {_runs("(SELECT * FROM shift_day WHERE ShiftID IS NOT NULL)", "EmpCode, ShiftID", "Date")}),
raw_runs AS (
  {_runs("(SELECT DISTINCT EmpCode, ShiftID, Date FROM roster)", "EmpCode, ShiftID", "Date")}),
marks AS (
  SELECT d.EmpCode, d.ShiftID, d.Date, (before.Date IS NULL)::INT AS ShiftChange
  FROM shift_day d LEFT JOIN shift_day before
    ON before.EmpCode = d.EmpCode AND before.ShiftID IS NOT DISTINCT FROM d.ShiftID
    AND before.Date = d.Date - 1),
history AS (
  SELECT EmpCode, Date, ShiftID,
         row_number() OVER (PARTITION BY EmpCode ORDER BY Date, ShiftID NULLS FIRST) AS place
  FROM roster),
changes AS (
  SELECT h.EmpCode, h.ShiftID, min(h.Date) AS ShiftStart, max(later.Date) AS ShiftEnd
  FROM history h
  LEFT JOIN history earlier ON earlier.EmpCode = h.EmpCode AND earlier.place = h.place - 1
  LEFT JOIN history later ON later.EmpCode = h.EmpCode AND later.place = h.place + 1
  WHERE coalesce(earlier.ShiftID <> h.ShiftID, earlier.ShiftID IS NULL)
  GROUP BY h.EmpCode, h.ShiftID),
located AS (
  SELECT m.*, l.* EXCLUDE (ID) FROM mapping m JOIN locations l ON l.ID = m.LocationID),
per_location AS (
  SELECT EmployeeCode, LocationID, min(georange) AS georange, max(rangeinkm::INT) AS rangeinkm,
         min(Latitude) AS Latitude, min(Longitude) AS Longitude, min(FromDate) AS FromDate,
         min(ToDate) AS ToDate, min(LocationAlias) AS LocationAlias
  FROM located GROUP BY EmployeeCode, LocationID),
ip_lists AS (
  SELECT EmployeeCode, to_json(list(json_merge_patch('{{}}', json_object('IPFrom', IPFrom, 'IPTo', IPTo))
           ORDER BY LocationID, IPFrom NULLS FIRST, IPTo NULLS FIRST))::VARCHAR AS IPRange
  FROM (SELECT DISTINCT EmployeeCode, LocationID FROM located)
  JOIN ip_ranges ON GeoConfigurationID = LocationID GROUP BY EmployeeCode),
per_shift AS (
  SELECT EmpCode, ShiftID, min(AttMode) AS AttMode, min(DiffIN) AS DiffIN, min(DiffOUT) AS DiffOUT,
         min(TotalworkedMinutes) AS TotalworkedMinutes, min(RegIN) AS RegIN, min(RegOut) AS RegOut,
         min(PreTime) AS PreTime, min(PostTime) AS PostTime, min(FromMin) AS FromMin,
         min(ToMin) AS ToMin, min(Date) AS ShiftStart, max(Date) AS ShiftEnd
  FROM roster GROUP BY EmpCode, ShiftID),
master AS (
  SELECT ShiftId AS ShiftID, min(ShiftName) AS ShiftName, min(InTime) AS InTime,
         max(OutTime) AS OutTime, max(TotalMinutes) AS TotalMinutes,
         min(SwipesSeperatorParam) AS SwipesSeperatorParam,
         min(ISWorkBtwnShifttime::TINYINT) AS ISWorkBtwnShifttime,
         min(IsBreakApplicable::TINYINT) AS IsBreakApplicable,
         min(IsNightShiftApplicable::TINYINT) AS IsNightShiftApplicable,
         min(IsActive::TINYINT) AS IsActive, min(AutoShift) AS AutoShift,
         min(ShiftAllowance::TINYINT) AS ShiftAllowance
  FROM shifts GROUP BY ShiftId),
pauses AS (
  SELECT ShiftId AS ShiftID, min(BreakInTime) AS BreakInTime, max(BreakOutTime) AS BreakOutTime,
         max(TotalBreakMinutes) AS TotalBreakMinutes, min(Applicable::TINYINT) AS Applicable
  FROM breaks GROUP BY ShiftId),
rule_values AS (
  SELECT ShiftID,
         min(RuleItemValue) FILTER (WHERE RuleConfigAttrItemName = 'Pre Time Minutes') AS PreTime,
         min(RuleItemValue) FILTER (WHERE RuleConfigAttrItemName = 'Post Time') AS PostTime
  FROM rules
  WHERE RuleEndDate IS NULL AND Org6 = '23215' AND RuleRelatedTo = 'Shift Properties'
    AND RuleConfigAttrItemName IN ('Pre Time Minutes', 'Post Time')
  GROUP BY ShiftID),
shift_range_lists AS (
  SELECT EmpCode, ShiftID, to_json(list(json_object('RangeStart', RangeStart, 'RangeEnd', RangeEnd)
           ORDER BY RangeStart)) AS ShiftRanges
  FROM shift_runs GROUP BY EmpCode, ShiftID),
location_range_lists AS (
  SELECT EmployeeCode, LocationID, to_json(list(json_object('RangeStart', RangeStart, 'RangeEnd', RangeEnd)
           ORDER BY RangeStart)) AS DateRanges
  FROM location_runs GROUP BY EmployeeCode, LocationID)"""

# Fields of the documents, in order.
ROSTER = "AttMode DiffIN DiffOUT TotalworkedMinutes RegIN RegOut PreTime PostTime FromMin ToMin".split()
SPAN = ["ShiftStart", "ShiftEnd"]
MASTER = ("InTime OutTime TotalMinutes SwipesSeperatorParam ISWorkBtwnShifttime IsBreakApplicable "
          "IsNightShiftApplicable IsActive AutoShift ShiftAllowance").split()
PAUSE = "BreakInTime BreakOutTime TotalBreakMinutes Applicable".split()
PLACE = "georange rangeinkm Latitude Longitude FromDate ToDate LocationAlias".split()
FLAGS = "IPCheckEnabled LocationCheckEnabled IPCheckEnabledOnMobile PunchIn PunchOut".split()
IDENTITY = ("ed_empcode AS EmpCode, ed_Salutation, ed_firstname, ed_MiddleName, ed_lastname, ed_empid, "
            "ED_Status, ESM_EmpStatusDesc")


def _with(body: str, *more: str) -> str:
    return "WITH " + ",\n".join([VIEWS.strip().removeprefix("WITH").strip(), STEPS.strip(), *more]) + "\n" + body


def _object(*fields: str) -> str:
    """A JSON object of columns; members that are NULL are left out."""
    return "json_merge_patch('{}', json_object(" + ", ".join(f"'{f}', {f}" for f in fields) + "))"


def _shift_documents(variant: str) -> str:
    """CTE shift_documents (EmpCode, ShiftDetails)."""
    if variant == "v1":
        return f"""shift_documents AS (
  SELECT EmpCode, to_json(list({_object("ShiftID", *ROSTER, "ShiftName", *SPAN, *MASTER, *PAUSE)}
                               ORDER BY ShiftID))::VARCHAR AS ShiftDetails
  FROM (SELECT * EXCLUDE (ShiftStart, ShiftEnd) FROM per_shift)
  JOIN master USING (ShiftID) JOIN pauses USING (ShiftID) JOIN changes USING (EmpCode, ShiftID)
  GROUP BY EmpCode)"""
    fields = [*ROSTER, "ShiftName", *([] if variant == "v4" else SPAN), *MASTER,
              *([] if variant == "v5" else PAUSE), "ShiftRanges"]
    source = "per_shift"
    if variant == "v4":
        source = "(SELECT * EXCLUDE (PreTime, PostTime) FROM per_shift) LEFT JOIN rule_values USING (ShiftID)"
    kind = "::VARCHAR" if variant in ("v2", "v4") else ""
    return f"""shift_objects AS (
  SELECT EmpCode, ShiftID, ({_object(*fields)}){kind} AS ShiftDetails
  FROM {source} JOIN master USING (ShiftID) LEFT JOIN pauses USING (ShiftID)
  LEFT JOIN shift_range_lists USING (EmpCode, ShiftID)),
shift_documents AS (
  SELECT EmpCode, to_json(list({_object("ShiftID", "ShiftDetails")}
                               ORDER BY ShiftID NULLS FIRST))::VARCHAR AS ShiftDetails
  FROM (SELECT EmpCode, ShiftID FROM per_shift) LEFT JOIN shift_objects USING (EmpCode, ShiftID)
  GROUP BY EmpCode)"""


def _location_documents(variant: str) -> str:
    """CTE location_documents (EmployeeCode, LocationDetails)."""
    if variant != "v5":
        return f"""location_documents AS (
  SELECT EmployeeCode, to_json(list({_object("LocationID", *PLACE)}
                                    ORDER BY LocationID))::VARCHAR AS LocationDetails
  FROM per_location GROUP BY EmployeeCode)"""
    fields = [f for f in PLACE if not f.endswith("Date")]
    return f"""location_objects AS (
  SELECT EmployeeCode, LocationID, {_object(*fields, "DateRanges")} AS LocationDetails
  FROM per_location LEFT JOIN location_range_lists USING (EmployeeCode, LocationID)),
location_documents AS (
  SELECT EmployeeCode, to_json(list({_object("LocationID", "LocationDetails")}
                                    ORDER BY LocationID NULLS FIRST))::VARCHAR AS LocationDetails
  FROM (SELECT DISTINCT EmployeeCode, LocationID FROM mapping)
  LEFT JOIN location_objects USING (EmployeeCode, LocationID)
  GROUP BY EmployeeCode)"""


def _flags(by_owner: bool) -> str:
    """CTE flags: the five flags of each employee, or one row for everybody."""
    any_of = ", ".join(f"coalesce(bool_or({f})::VARCHAR, 'false') AS {f}" for f in FLAGS)
    if not by_owner:
        return f"flags AS (SELECT ed_empcode, found.* FROM employees, (SELECT {any_of} FROM located) found)"
    return f"""flags AS (
  SELECT ed_empcode, {any_of} FROM employees LEFT JOIN located ON EmployeeCode = ed_empcode
  GROUP BY ed_empcode)"""


def report_sql(variant: str, top_n: int | None) -> str:
    return _with(f"""
SELECT {IDENTITY}, {", ".join(FLAGS)}, ShiftDetails, LocationDetails, IPRange
FROM employees JOIN status ON ED_Status = ESM_EmpStatusID
JOIN flags USING (ed_empcode)
JOIN (SELECT DISTINCT EmpCode FROM roster) present ON present.EmpCode = ed_empcode
LEFT JOIN shift_documents ON shift_documents.EmpCode = ed_empcode
LEFT JOIN location_documents ON location_documents.EmployeeCode = ed_empcode
LEFT JOIN ip_lists ON ip_lists.EmployeeCode = ed_empcode
ORDER BY ed_empcode {f"LIMIT {top_n}" if top_n is not None else ""}""",
                 _flags(variant != "v1"), _shift_documents(variant), _location_documents(variant))


def oracle_sql() -> dict[str, str]:
    q = {
        "employee_status_topn": _with(f"""
SELECT {IDENTITY} FROM employees JOIN status ON ED_Status = ESM_EmpStatusID
ORDER BY ed_empcode LIMIT 10"""),
        "active_employees_exists": _with("""
SELECT ed_empcode AS EmpCode, ed_firstname, ED_Status
FROM employees WHERE ed_empcode IN (SELECT EmpCode FROM roster)"""),
        "allow_list_in": _with("SELECT EmployeeCode, IPRange FROM ip_lists"),
        "resolve_daily_shift": _with("SELECT EmpCode, Date, ShiftID FROM shift_day"),
        "shift_change_marks": _with("SELECT EmpCode, ShiftID, Date, ShiftChange FROM marks"),
        "shift_island_numbers": _with("""
SELECT m.EmpCode, m.ShiftID, m.Date, count(*) AS ShiftGroup
FROM marks m JOIN marks s
  ON s.EmpCode = m.EmpCode AND s.ShiftID IS NOT DISTINCT FROM m.ShiftID AND s.Date <= m.Date AND s.ShiftChange = 1
GROUP BY m.EmpCode, m.ShiftID, m.Date"""),
        "shift_ranges": _with("SELECT * FROM shift_runs"),
        "shift_blocks": _with("""
SELECT EmpCode, ShiftID, RangeStart AS ShiftStart, RangeEnd AS ShiftEnd FROM raw_runs"""),
        "shift_span": _with("SELECT EmpCode, ShiftID, ShiftStart, ShiftEnd FROM per_shift"),
        "change_blocks": _with("SELECT * FROM changes"),
        "expand_days": _with("SELECT * FROM days"),
        "resolve_overlaps": _with("SELECT * FROM day_winner"),
        "location_ranges": _with("SELECT * FROM location_runs"),
        "access_flags": _with(f"SELECT ed_empcode AS EmpCode, {', '.join(FLAGS)} FROM flags", _flags(True)),
        "access_flags_global": _with(
            f"SELECT ed_empcode AS EmpCode, {', '.join(FLAGS)} FROM flags", _flags(False)),
        "rule_lookup": _with("SELECT * FROM rule_values"),
        "location_summary": _with("SELECT * FROM per_location"),
        "location_details": _with("SELECT * FROM location_documents", _location_documents("v5")),
        "shift_summary_inner": _with("""
SELECT * FROM per_shift JOIN master USING (ShiftID) JOIN pauses USING (ShiftID)"""),
        "shift_summary_left": _with("""
SELECT * FROM per_shift JOIN master USING (ShiftID) LEFT JOIN pauses USING (ShiftID)"""),
    }
    q["first_value_window"] = q["resolve_daily_shift"]
    q["shift_ranges_timestamps"] = q["shift_ranges"]
    q["location_ranges_segments"] = q["location_ranges_days"] = q["location_ranges"]
    q["resolve_overlaps_pieces"] = q["resolve_overlaps"]
    q["rule_lookup_view"] = q["rule_lookup_collated"] = q["rule_lookup"]
    q["allow_list_shared"] = q["allow_list_in"]
    q["long_assignments"] = _with("""
SELECT EmployeeCode, LocationID, FromDate, ToDate, (ToDate - FromDate + 1)::INT AS Days
FROM mapping WHERE ToDate - FromDate >= 30""")
    dirty = """dirty AS (
  SELECT EmployeeCode, LocationID, CASE WHEN georange % 19 = 0 THEN rangeinkm::VARCHAR || '.5'
         WHEN georange % 23 = 0 THEN 'n/a' ELSE rangeinkm::VARCHAR END AS shown
  FROM mapping)"""
    whole = "CASE WHEN regexp_full_match(shown, '[0-9]+') THEN shown::INT END"
    q["dirty_ranges"] = _with(f"""
SELECT EmployeeCode, LocationID, max({whole}) AS rangeinkm FROM dirty GROUP BY ALL""", dirty)
    q["dirty_ranges_refused"] = _with(f"""
SELECT 'rangeinkm' AS "column", count(*) FILTER ({whole} IS NULL) AS refused FROM dirty""", dirty)
    q["doc_locations_datetime"] = _with(f"""
SELECT EmployeeCode, to_json(list({_object("LocationID", *PLACE)} ORDER BY LocationID))::VARCHAR AS LocationDetails
FROM (SELECT * REPLACE (replace(FromDate::VARCHAR, ' ', 'T') AS FromDate, replace(ToDate::VARCHAR, ' ', 'T') AS ToDate)
      FROM (SELECT EmployeeCode, LocationID, min(georange) AS georange, max(rangeinkm::INT) AS rangeinkm,
                   min(Latitude) AS Latitude, min(Longitude) AS Longitude,
                   min(FromDate::TIMESTAMP + to_hours(georange % 24)) AS FromDate,
                   min(ToDate::TIMESTAMP + to_hours(18) + to_milliseconds(CASE WHEN georange % 4 = 0 THEN 250 ELSE 0 END)) AS ToDate,
                   min(LocationAlias) AS LocationAlias
            FROM located GROUP BY EmployeeCode, LocationID))
GROUP BY EmployeeCode""")
    for name, variant in (("doc_flat", "v1"), ("doc_text", "v2"), ("doc_nested", "v3")):
        q[name] = _with("""
SELECT EmpCode, ShiftDetails
FROM (SELECT DISTINCT EmpCode FROM roster) LEFT JOIN shift_documents USING (EmpCode)""",
                        _shift_documents(variant))
    for variant, n in {"v1": 10, "v2": 100, "v3": 10, "v4": 10, "v5": 10}.items():
        q[f"report_{variant}"] = report_sql(variant, n)
        q[f"report_{variant}_all"] = report_sql(variant, None)
    q["written_report"] = q["report_v3_all"]
    return q
