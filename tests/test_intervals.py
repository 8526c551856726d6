"""Calendar operators on hand-written edge rows and against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from rota.operators import intervals as iv
from tests.helpers import (
    brute_change_blocks, brute_islands, brute_resolved_ranges, day, frame, rowset,
)

ROSTER = "EmpCode string, ShiftID int, Date date"
MAP = "EmployeeCode string, LocationID int, FromDate date, ToDate date"


def ranges(spark, rows):
    df = frame(spark, rows, ROSTER)
    return rowset(iv.daily_ranges(df, "EmpCode", "Date", "ShiftID"))


def test_contiguous_gap_and_duplicates(spark):
    assert ranges(spark, [("A", 1, day(1)), ("A", 1, day(2)), ("A", 1, day(3))]) == [
        ("A", 1, day(1), day(3))]
    assert ranges(spark, [("A", 1, day(1)), ("A", 1, day(2)), ("A", 1, day(4))]) == [
        ("A", 1, day(1), day(2)), ("A", 1, day(4), day(4))]
    assert ranges(spark, [("A", 1, day(1)), ("A", 1, day(1)), ("A", 1, day(2))]) == [
        ("A", 1, day(1), day(2))]


def test_highest_shift_wins_the_day(spark):
    df = frame(spark, [("A", 1, day(2)), ("A", 2, day(2))], ROSTER)
    assert rowset(iv.resolve_daily(df, "EmpCode", "Date", "ShiftID")) == [("A", day(2), 2)]
    # shift 1 never wins a day: no range for it
    assert ranges(spark, [("A", 1, day(2)), ("A", 2, day(2))]) == [("A", 2, day(2), day(2))]


def test_resolution_splits_ranges(spark):
    rows = [("A", 1, day(1)), ("A", 1, day(2)), ("A", 1, day(3)), ("A", 2, day(2))]
    assert ranges(spark, rows) == [
        ("A", 1, day(1), day(1)), ("A", 1, day(3), day(3)), ("A", 2, day(2), day(2))]


def test_null_candidate_never_wins(spark):
    df = frame(spark, [("A", None, day(1)), ("A", 3, day(1)), ("A", None, day(2))], ROSTER)
    assert rowset(iv.resolve_daily(df, "EmpCode", "Date", "ShiftID")) == [
        ("A", day(1), 3), ("A", day(2), None)]
    assert ranges(spark, [("A", None, day(1)), ("A", 3, day(1)), ("A", None, day(2))]) == [
        ("A", 3, day(1), day(1))]


def test_first_value_form_equals_max_form(spark):
    rnd = random.Random(7)
    rows = [(f"E{rnd.randrange(20)}", rnd.choice([None, 1, 2, 3, 4]), day(rnd.randrange(1, 40)))
            for _ in range(2000)]
    df = frame(spark, rows, ROSTER)
    assert rowset(iv.resolve_daily(df, "EmpCode", "Date", "ShiftID")) == rowset(
        iv.first_value_daily(df, "EmpCode", "Date", "ShiftID"))


def test_year_end_and_leap_day(spark):
    rows = [("A", 1, dt.date(2023, 12, 31)), ("A", 1, dt.date(2024, 1, 1)),
            ("B", 1, dt.date(2024, 2, 28)), ("B", 1, dt.date(2024, 2, 29)),
            ("B", 1, dt.date(2024, 3, 1))]
    assert ranges(spark, rows) == [
        ("A", 1, dt.date(2023, 12, 31), dt.date(2024, 1, 1)),
        ("B", 1, dt.date(2024, 2, 28), dt.date(2024, 3, 1))]


def test_islands_match_brute_force(spark):
    rnd = random.Random(11)
    rows = [((f"E{rnd.randrange(30)}", rnd.randrange(3)), day(rnd.randrange(1, 60)))
            for _ in range(3000)]
    df = frame(spark, [(k[0], k[1], d) for k, d in rows], ROSTER)
    got = rowset(iv.islands(df, ["EmpCode", "ShiftID"], "Date"))
    want = [(k[0], k[1], s, e) for k, s, e in brute_islands(rows)]
    assert got == sorted(want, key=repr)


def test_islands_are_disjoint_maximal_and_cover(spark):
    rnd = random.Random(3)
    rows = [("E", 1, day(rnd.randrange(1, 200))) for _ in range(300)]
    got = iv.islands(frame(spark, rows, ROSTER), ["EmpCode", "ShiftID"], "Date").collect()
    spans = sorted((r.RangeStart, r.RangeEnd) for r in got)
    for (a1, b1), (a2, b2) in zip(spans, spans[1:]):
        assert b1 + dt.timedelta(days=1) < a2  # disjoint and not touching (maximal)
    covered = {a + dt.timedelta(days=i) for a, b in spans for i in range((b - a).days + 1)}
    assert covered == {d for _, _, d in rows}


def test_island_marks_literal_form(spark):
    rows = [("A", 1, day(1)), ("A", 1, day(2)), ("A", 1, day(4)), ("A", 1, day(4))]
    got = rowset(iv.island_marks(frame(spark, rows, ROSTER), ["EmpCode", "ShiftID"], "Date"))
    assert sorted((r[2], r[3], r[4]) for r in got) == [
        (day(1), 1, 1), (day(2), 0, 1), (day(4), 0, 2), (day(4), 1, 2)]


def test_change_blocks_example(spark):
    rows = [("A", 1, day(1)), ("A", 1, day(2)), ("A", 2, day(3)), ("A", 1, day(4))]
    got = rowset(iv.change_blocks(frame(spark, rows, ROSTER), "EmpCode", "Date", "ShiftID"))
    assert got == [("A", 1, day(1), day(2)), ("A", 2, day(3), day(4))]


def test_change_blocks_match_brute_force_with_duplicates_and_nulls(spark):
    rnd = random.Random(5)
    rows = []
    for e in range(400):
        for _ in range(rnd.randrange(1, 12)):
            rows.append((f"E{e}", rnd.choice([None, 1, 2, 3]), day(rnd.randrange(1, 8))))
    df = frame(spark, rows, ROSTER)
    got = rowset(iv.change_blocks(df, "EmpCode", "Date", "ShiftID"))
    assert got == brute_change_blocks([(e, d, s) for e, s, d in rows])
    # same result from the reduced (emp, shift, day, count) form
    reduced = df.groupBy("EmpCode", "ShiftID", "Date").agg(F.count(F.lit(1)).alias("_rows"))
    assert rowset(iv.change_blocks(reduced, "EmpCode", "Date", "ShiftID", weight="_rows")) == got


def test_span_equals_min_max_of_blocks(spark):
    rnd = random.Random(9)
    rows = [(f"E{rnd.randrange(10)}", rnd.randrange(3), day(rnd.randrange(1, 50)))
            for _ in range(1000)]
    df = frame(spark, rows, ROSTER)
    blocks = iv.shift_blocks(df).groupBy("EmpCode", "ShiftID").agg(
        F.min("ShiftStart").alias("ShiftStart"), F.max("ShiftEnd").alias("ShiftEnd"))
    assert rowset(iv.span(df, ["EmpCode", "ShiftID"], "Date")) == rowset(blocks)


def test_expand_days_edges(spark):
    rows = [("A", 1, day(3), day(3)),          # one day
            ("A", 2, day(5), day(4)),          # reversed: nothing
            ("A", 3, day(5), None),            # open end: nothing
            ("A", 4, None, day(5)),            # no start: nothing
            ("B", 5, dt.date(2023, 12, 31), dt.date(2024, 1, 1))]
    got = rowset(iv.expand_days(frame(spark, rows, MAP), "FromDate", "ToDate",
                                keep=["EmployeeCode", "LocationID"]))
    assert got == [("A", 1, day(3)), ("B", 5, dt.date(2023, 12, 31)),
                   ("B", 5, dt.date(2024, 1, 1))]


def test_overlap_and_touching_intervals(spark):
    rows = [("A", 10, day(1), day(5)), ("A", 11, day(3), day(3)),
            ("B", 10, day(1), day(2)), ("B", 10, day(3), day(4))]
    got = rowset(iv.resolved_ranges(frame(spark, rows, MAP), "EmployeeCode", "FromDate",
                                    "ToDate", "LocationID"))
    assert got == [("A", 10, day(1), day(2)), ("A", 10, day(4), day(5)),
                   ("A", 11, day(3), day(3)), ("B", 10, day(1), day(4))]


def test_resolved_ranges_match_brute_force(spark):
    rnd = random.Random(13)
    rows = []
    for o in range(60):
        for _ in range(rnd.randrange(1, 8)):
            a = day(rnd.randrange(1, 90))
            b = a + dt.timedelta(days=rnd.randrange(-3, 25))
            rows.append((f"O{o}", rnd.randrange(0, 6), a, b if rnd.random() > 0.05 else None))
    df = frame(spark, rows, MAP)
    got = rowset(iv.resolved_ranges(df, "EmployeeCode", "FromDate", "ToDate", "LocationID"))
    assert got == brute_resolved_ranges(rows)
    # re-expanding the ranges gives back exactly the resolved days
    won = rowset(iv.resolve_overlaps(df, "EmployeeCode", "FromDate", "ToDate", "LocationID"))
    back = rowset(iv.expand_days(
        iv.resolved_ranges(df, "EmployeeCode", "FromDate", "ToDate", "LocationID"),
        "RangeStart", "RangeEnd", out="SingleDate", keep=["EmployeeCode", "LocationID"])
        .select("EmployeeCode", "SingleDate", "LocationID"))
    assert back == won


def test_segment_form_matches_brute_force_and_long_intervals(spark):
    rnd = random.Random(17)
    rows = []
    for o in range(50):
        for _ in range(rnd.randrange(1, 7)):
            a = day(rnd.randrange(1, 60)) if rnd.random() > 0.1 else dt.date(1899, 12, 30)
            b = a + dt.timedelta(days=rnd.randrange(-2, 30))
            rows.append((f"O{o}", rnd.choice([None, 1, 2, 3, 4]), a,
                         b if rnd.random() > 0.05 else None))
    df = frame(spark, rows, MAP)
    got = rowset(iv.resolved_ranges(df, "EmployeeCode", "FromDate", "ToDate", "LocationID",
                                    method="segments"))
    assert got == brute_resolved_ranges(rows)
    # open-ended assignment to the last representable day: no day expansion
    far = frame(spark, [("A", 1, day(1), dt.date(9999, 12, 31)), ("A", 2, day(10), day(12))], MAP)
    got = rowset(iv.resolved_ranges(far, "EmployeeCode", "FromDate", "ToDate", "LocationID",
                                    method="segments"))
    assert got == [("A", 1, day(1), day(9)), ("A", 1, day(13), dt.date(9999, 12, 31)),
                   ("A", 2, day(10), day(12))]


def test_restrict_owners(spark):
    rows = [("A", 1, day(1), day(2)), ("B", 1, day(1), day(2))]
    owners = frame(spark, [("B",)], "k string")
    got = rowset(iv.resolved_ranges(frame(spark, rows, MAP), "EmployeeCode", "FromDate",
                                    "ToDate", "LocationID", owners=owners))
    assert got == [("B", 1, day(1), day(2))]


def test_hot_key_is_reduced_before_the_window(spark):
    # One employee owns a third of the rows, many per day: every ordered
    # operator must give the brute-force result, and the window input for the
    # hot key is its distinct (shift, day) pairs, not its raw rows.
    rnd = random.Random(21)
    rows = [(f"E{rnd.randrange(200)}", rnd.randrange(1, 4), day(rnd.randrange(1, 30)))
            for _ in range(4000)]
    rows += [("HOT", rnd.randrange(1, 4), day(rnd.randrange(1, 30))) for _ in range(2000)]
    df = frame(spark, rows, ROSTER)
    assert rowset(iv.change_blocks(df, "EmpCode", "Date", "ShiftID")) == brute_change_blocks(
        [(e, d, s) for e, s, d in rows])
    got = rowset(iv.islands(df, ["EmpCode", "ShiftID"], "Date"))
    want = [(k[0], k[1], s, e) for k, s, e in brute_islands([((e, s), d) for e, s, d in rows])]
    assert got == sorted(want, key=repr)
    assert rowset(iv.first_value_daily(df, "EmpCode", "Date", "ShiftID")) == rowset(
        iv.resolve_daily(df, "EmpCode", "Date", "ShiftID"))
    hot = df.where(F.col("EmpCode") == "HOT")
    assert hot.select("ShiftID", "Date").distinct().count() <= 3 * 29 < hot.count()


STAMPED = "EmpCode string, ShiftID int, Date timestamp"


def at(d, hour):
    return dt.datetime.combine(day(d), dt.time(hour))


def test_times_of_day_do_not_split_runs(spark):
    df = frame(spark, [("A", 1, at(1, 8)), ("A", 1, at(1, 20)), ("A", 1, at(2, 8))], STAMPED)
    want = [("A", 1, day(1), day(2))]
    assert rowset(iv.islands(df, ["EmpCode", "ShiftID"], "Date")) == want
    assert rowset(iv.shift_blocks(df)) == want
    assert rowset(iv.daily_ranges(df, "EmpCode", "Date", "ShiftID")) == want
    marks = iv.island_marks(df, ["EmpCode", "ShiftID"], "Date")
    assert {r.ShiftGroup for r in marks.collect()} == {1}


@pytest.mark.parametrize("method", ["days", "segments"])
def test_times_of_day_of_interval_bounds(spark, method):
    schema = "EmployeeCode string, LocationID int, FromDate timestamp, ToDate timestamp"
    df = frame(spark, [("A", 1, at(1, 8), at(3, 7)), ("A", 2, at(2, 23), at(2, 23))], schema)
    got = rowset(iv.resolved_ranges(df, "EmployeeCode", "FromDate", "ToDate", "LocationID", method=method))
    assert got == [("A", 1, day(1), day(1)), ("A", 1, day(3), day(3)), ("A", 2, day(2), day(2))]


def test_other_day_types_are_an_error(spark):
    df = frame(spark, [("A", 1, "2024-01-01")], "EmpCode string, ShiftID int, Date string")
    with pytest.raises(TypeError):
        iv.islands(df, ["EmpCode", "ShiftID"], "Date")


@pytest.mark.parametrize("method", ["days", "segments"])
def test_composite_owners(spark, method):
    schema = "org string, emp string, LocationID int, FromDate date, ToDate date"
    rows = [("O1", "A", 1, day(1), day(2)), ("O1", "B", 1, day(1), day(2)), ("O2", "A", 1, day(1), day(2))]
    df, owners = frame(spark, rows, schema), frame(spark, [("O1", "A")], "a string, b string")
    call = lambda o: iv.resolved_ranges(
        df, ["org", "emp"], "FromDate", "ToDate", "LocationID", owners=o, method=method)
    assert rowset(call(owners)) == [("O1", "A", 1, day(1), day(2))]
    with pytest.raises(ValueError):
        call(owners.select("a"))
