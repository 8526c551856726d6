"""JSON text of timestamps, candidates-first top N, interval-valued winners, the
length guard, dirty casts, factorised allow lists, collated keys."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from rota.functions import refused_casts, whole_number
from rota.operators import access, documents, intervals
from rota.plans import catalog, reports
from rota.sources import role_tables
from tests.conftest import SF_SMALL
from tests.helpers import day, frame, rowset

STAMP = dt.datetime(2024, 1, 1, 8)


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_timestamps_print_without_zone_and_empty_fractions(spark, kind):
    df = frame(spark, [(1, STAMP), (2, STAMP.replace(microsecond=250_000)), (3, STAMP.replace(microsecond=1)), (4, None)],
               f"k int, t {kind}")
    df = df.select("k", F.struct("k", "t").alias("one"), F.array(F.struct("t")).alias("many"),
                   F.create_map(F.lit("a"), F.col("t")).alias("named"))
    out = {json.loads(r.one)["k"]: r for r in documents.to_json_columns(df, ["one", "many", "named"]).collect()}
    shown = {1: "2024-01-01T08:00:00", 2: "2024-01-01T08:00:00.25", 3: "2024-01-01T08:00:00.000001"}
    for k, text in shown.items():
        assert json.loads(out[k].one) == {"k": k, "t": text}
        assert json.loads(out[k].many) == [{"t": text}] and json.loads(out[k].named) == {"a": text}
    assert out[4].one == '{"k":4}' and out[4].many == "[{}]"


def test_absent_objects_stay_absent(spark):
    df = frame(spark, [(1, None), (2, {"t": STAMP})], "k int, o struct<t:timestamp>")
    assert rowset(documents.to_json_columns(df, ["o"])) == [(1, None), (2, '{"t":"2024-01-01T08:00:00"}')]


def test_timestamps_in_text_details(spark):
    df = frame(spark, [(1, STAMP)], "k int, t timestamp")
    (row,) = df.select(documents.detail_object(["k", "t"], "text", df.schema).alias("d")).collect()
    assert row.d == '{"k":1,"t":"2024-01-01T08:00:00"}'


def test_columns_without_timestamps_are_left_alone(spark):
    df = frame(spark, [(1, day(1))], "k int, d date").select(F.struct("k", "d").alias("o"))
    value = F.col("o")
    assert documents.json_ready(value, df.schema["o"].dataType) is value
    assert documents.to_json_columns(df, ["o"]).first().o == '{"k":1,"d":"2024-01-01"}'


@pytest.mark.parametrize("n", [1, 3, 10, 500])
@pytest.mark.parametrize("block", [1, 7, None])
def test_first_owners_equal_the_head_of_all(spark, n, block):
    rng = random.Random(n)
    keys = [rng.randrange(300) for _ in range(120)] + [None, None]
    driving = frame(spark, [(k, i) for i, k in enumerate(keys)], "k int, i int")
    facts = frame(spark, [(rng.randrange(300),) for _ in range(90)] + [(None,)], "f int")
    every = sorted(tuple(r) for r in access.owners_with(driving, facts, "k", "f").collect())
    got = [tuple(r) for r in access.first_owners_with(driving, facts, "k", "f", n, block).collect()]
    assert len(got) == min(n, len(every)) and [k for k, _ in got] == [k for k, _ in every[:n]]
    assert set(got) <= set(every)


def test_first_owners_without_any(spark):
    driving = frame(spark, [(1,), (2,)], "k int")
    none = frame(spark, [], "f int")
    assert access.first_owners_with(driving, none, "k", "f", 5).collect() == []
    assert access.first_owners_with(driving.limit(0), driving.toDF("f"), "k", "f", 5).collect() == []


def test_top_n_scans_only_the_candidates_key_range(spark, monkeypatch):
    seen = []
    cut = access.cut_lineage
    monkeypatch.setattr(access, "cut_lineage", lambda df: seen.append(
        df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    reports.driving_set(role_tables(spark, SF_SMALL), 5).collect()
    assert seen and all("GreaterThanOrEqual(user_id" in p and "LessThanOrEqual(user_id" in p for p in seen)


def test_pieces_are_disjoint_and_expand_to_the_daily_winners(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(150):
        a = rng.randrange(1, 400)
        rows.append((rng.randrange(4), rng.choice([None, 1, 2, 3, 4]), day(a),
                     None if rng.random() < 0.1 else day(a + rng.randrange(-3, 70))))
    df = frame(spark, rows, "o int, c int, a date, b date")
    pieces = intervals.overlap_pieces(df, "o", "a", "b", "c")
    days = intervals.expand_days(pieces, "PieceStart", "PieceEnd")
    assert rowset(days.select("o", "SingleDate", "c")) == rowset(intervals.resolve_overlaps(df, "o", "a", "b", "c"))
    assert days.groupBy("o", "SingleDate").count().where("count > 1").count() == 0


def test_pieces_of_open_ended_intervals(spark):
    far, first = dt.date(9999, 12, 31), dt.date(1, 1, 1)
    df = frame(spark, [(1, 5, first, far), (1, 9, day(10), day(12))], "o int, c int, a date, b date")
    assert rowset(intervals.overlap_pieces(df, "o", "a", "b", "c")) == sorted(
        [(1, first, day(9), 5), (1, day(10), day(12), 9), (1, day(13), far, 5)], key=repr)
    assert rowset(intervals.resolved_ranges(df, "o", "a", "b", "c")) == sorted(
        [(1, 5, first, day(9)), (1, 5, day(13), far), (1, 9, day(10), day(12))], key=repr)


def test_levels_probed_follow_the_lengths(spark):
    """Intervals of up to two days need two levels, whatever the calendar's."""
    rows = [(1, i % 3, day(3 * i), day(3 * i + i % 2)) for i in range(1, 200)]
    df = frame(spark, rows, "o int, c int, a date, b date")
    plan = intervals.overlap_pieces(df, "o", "a", "b", "c")
    assert plan.count() == 199


def test_rejected_and_kept_rows_make_up_the_input(spark):
    rows = [(1, day(1), day(30)), (2, day(1), day(31)), (3, day(9), day(2)), (4, day(1), None), (5, None, day(1)),
            (6, day(1), dt.date(9999, 12, 31))]
    df = frame(spark, rows, "k int, a date, b date")
    kept, rejected = intervals.split_by_length(df, "a", "b", 30)
    assert sorted(r.k for r in kept.collect()) == [1, 3, 4, 5]
    assert [(r.k, r.Days) for r in rejected.orderBy("k").collect()][0] == (2, 31)
    assert rowset(kept.unionAll(rejected.drop("Days"))) == rowset(df)


def test_dirty_numbers_are_neither_raised_nor_lost(spark):
    df = frame(spark, [("1.5", "7"), ("12", None), (None, "x"), (" 3 ", "9")], "a string, b string")
    assert [r[0] for r in df.select(whole_number("a")).collect()] == [None, 12, None, 3]
    assert dict(tuple(r) for r in refused_casts(df, ["a", "b"]).collect()) == {"a": 1, "b": 1}


def test_factorised_allow_lists_expand_to_the_plain_ones(spark):
    t = role_tables(spark, SF_SMALL)
    owners, lists = access.allow_list_sets(t.ip_ranges, t.mapping, t.locations)
    plain = access.allow_list(t.ip_ranges, t.mapping, t.locations)
    joined = owners.join(lists, "LocationSet").select("EmployeeCode", "IPRange")
    assert rowset(joined) == rowset(plain)


def test_owners_with_one_set_of_locations_share_one_list(spark):
    ips = frame(spark, [(1, "a", "b"), (2, "c", "d"), (1, "a", "b")], "GeoConfigurationID int, IPFrom string, IPTo string")
    mapping = frame(spark, [(o, loc) for o in range(1000) for loc in (2, 1, 1)], "EmployeeCode int, LocationID int")
    master = frame(spark, [(1,), (2,)], "ID int")
    owners, lists = access.allow_list_sets(ips, mapping, master)
    assert owners.count() == 1000 and lists.count() == 1
    assert [tuple(e) for e in lists.first().IPRange] == [("a", "b"), ("a", "b"), ("c", "d")]


def test_collated_keys_join_group_and_deduplicate(spark):
    df = frame(spark, [("Ab", 1), ("aB", 2), ("c", 3), (None, 4)], "k string, v int")
    other = frame(spark, [("AB",), ("C",), ("C",)], "f string")
    low = access.collated(df, ["k"])
    assert low.groupBy("k").count().count() == 3 and low.select("k").distinct().count() == 3
    assert sorted(r.v for r in access.owners_with(low, access.collated(other, ["f"]), "k", "f").collect()) == [1, 2, 3]
    assert access.owners_with(df, other, "k", "f").count() == 0


def test_collated_query_is_registered():
    assert "rule_lookup_collated" in catalog.queries()
