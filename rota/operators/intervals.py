"""Calendar operators: daily resolution, islands, change blocks, interval expansion.

Scale notes
-----------
Every operator that needs an ordered pass per key first reduces its input to
distinct (key, day) rows with a grouped aggregate. The aggregate runs a partial
(map-side) step before its shuffle, so a key that owns a large share of the
rows is collapsed locally before anything moves, and the shuffle is spread on
(key, day). Only then does a window partition by the key alone; its partition
is bounded by the number of distinct days of that key (a calendar, not a row
count), never by the raw row count of a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NullType, TimestampNTZType, TimestampType

from rota.functions.columns import day_sequence

Keys = str | Sequence[str]


def _keys(keys: Keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def as_days(df: DataFrame, *columns: str) -> DataFrame:
    """``columns`` as DATE: a time of day is dropped at the entry of every
    operator that steps by days. Other types are an error."""
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, (TimestampType, TimestampNTZType, NullType)):
            df = df.withColumn(c, F.col(c).cast("date"))
        elif not isinstance(kind, DateType):
            raise TypeError(f"{c} must be a date or timestamp, not {kind.simpleString()}")
    return df


def resolve_daily(df: DataFrame, owner: Keys, day: str, candidate: str,
                  out: str | None = None) -> DataFrame:
    """One candidate per (owner, day): the highest one wins.

    Same as ``DISTINCT owner, FIRST_VALUE(candidate) OVER (PARTITION BY owner,
    day ORDER BY candidate DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED
    FOLLOWING), day``: descending order puts NULL last, so the first value is
    the maximum and NULL only when every candidate of the day is NULL.
    """
    owners = _keys(owner)
    return as_days(df, day).groupBy(*owners, day).agg(F.max(candidate).alias(out or candidate))


def first_value_daily(df: DataFrame, owner: Keys, day: str, candidate: str,
                      out: str | None = None) -> DataFrame:
    """The window form of ``resolve_daily`` (FIRST_VALUE over a descending
    order, then DISTINCT), kept for parity checks; ``resolve_daily`` is the
    cheaper plan (partial aggregation instead of a sort per day).

    The rows are de-duplicated to (owner, day, candidate) first - the DISTINCT
    result does not change - so a window partition holds one row per distinct
    candidate of the day, however many raw rows a hot (owner, day) has."""
    owners = _keys(owner)
    w = (Window.partitionBy(*owners, day).orderBy(F.col(candidate).desc_nulls_last())
         .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    distinct_rows = as_days(df.select(*owners, day, candidate), day).distinct()
    return (distinct_rows
            .select(*owners, day, F.first_value(F.col(candidate)).over(w).alias(out or candidate))
            .distinct())


def island_marks(df: DataFrame, keys: Keys, day: str, change: str = "ShiftChange",
                 group: str = "ShiftGroup") -> DataFrame:
    """Row-level island marks, the literal form: ``change`` is 1 on the first
    row of a key and where ``day > prev + 1``, ``group`` is the running sum of
    ``change``. Duplicate days never start an island. Kept for inspection and
    parity; ``islands`` collapses without materialising the marks. The
    window partition is the whole key: feed it reduced rows (one per key and
    day, e.g. ``resolve_daily`` output, as the registered queries do)."""
    ks, df = _keys(keys), as_days(df, day)
    w = Window.partitionBy(*ks).orderBy(day)
    prev = F.lag(day).over(w)
    marked = df.withColumn(
        change,
        F.when(prev.isNull(), 1).when(F.col(day) > F.date_add(prev, 1), 1).otherwise(0))
    return marked.withColumn(
        group, F.sum(change).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def islands(df: DataFrame, keys: Keys, day: str, start: str = "RangeStart",
            end: str = "RangeEnd", unique: bool = False) -> DataFrame:
    """Collapse dated rows into maximal runs of consecutive days per key.

    Result: (keys..., start, end). Duplicate days stay in one island, a single
    missing day splits. NULL days belong to no range. ``unique=True`` says the
    input already has one row per (keys, day) and skips the de-duplication.

    Plan: distinct (keys, day) with partial aggregation, then one window per
    key (``day - row_number`` is constant along a run of consecutive days),
    then a group-by that reuses the window's partitioning.
    """
    ks = _keys(keys)
    days = as_days(df.select(*ks, day), day).where(F.col(day).isNotNull())
    if not unique:
        days = days.distinct()
    w = Window.partitionBy(*ks).orderBy(day)
    run = F.date_sub(F.col(day), F.row_number().over(w))
    return (days.withColumn("_run", run)
            .groupBy(*ks, "_run")
            .agg(F.min(day).alias(start), F.max(day).alias(end))
            .drop("_run"))


def span(df: DataFrame, keys: Keys, day: str, start: str = "ShiftStart",
         end: str = "ShiftEnd") -> DataFrame:
    """First and last day per key. Equals MIN(block start) / MAX(block end)
    over the islands of the key, because the islands partition its days."""
    ks = _keys(keys)
    return as_days(df, day).groupBy(*ks).agg(F.min(day).alias(start), F.max(day).alias(end))


def shift_blocks(df: DataFrame, keys: Keys = ("EmpCode", "ShiftID"), day: str = "Date",
                 start: str = "ShiftStart", end: str = "ShiftEnd") -> DataFrame:
    """The block relation of the raw roster: islands per (employee, shift)
    without daily resolution."""
    return islands(df, keys, day, start=start, end=end)


def change_blocks(df: DataFrame, owner: Keys, day: str, value: str,
                  start: str = "ShiftStart", end: str = "ShiftEnd",
                  weight: str | None = None) -> DataFrame:
    """Change blocks per (owner, value), the LEAD/LAG form.

    Rows of an owner are ordered by (day, value NULLS FIRST). A row is kept
    when the previous row's value is NULL (or there is none) or differs from
    its own; NULL never differs. Result per (owner, value): start = MIN(day of
    kept rows), end = MAX(day of the row *after* each kept row) - the day of
    the next row, not the end of the run; NULL at the end of history.

    The rows are pre-aggregated to (owner, day, value, count) before the
    window, so a hot owner costs one row per distinct (day, value). The count
    decides what the duplicates of a row contribute: a duplicate follows its
    twin, so it is kept only for a NULL value, and the twin's next day is its
    own day.

    ``weight`` names a row-count column when the input is already reduced
    (e.g. ``roster_daily``); raw rows count one each.
    """
    owners, df = _keys(owner), as_days(df, day)
    d, v, n = F.col(day), F.col(value), F.col("_n")
    count = F.sum(weight) if weight else F.count(F.lit(1))
    runs = (df.where(d.isNotNull())
            .groupBy(*owners, day, value).agg(count.alias("_n")))
    w = Window.partitionBy(*owners).orderBy(d.asc(), v.asc_nulls_first())
    prev_v = F.lag(value).over(w)
    is_first = F.lag(day).over(w).isNull()
    next_d = F.lead(day).over(w)
    marked = runs.select(
        *owners, day, value, "_n",
        (is_first | prev_v.isNull() | F.coalesce(prev_v != v, F.lit(False))).alias("_first_kept"),
        next_d.alias("_next"),
    )
    fk, nxt = F.col("_first_kept"), F.col("_next")
    kept = fk | (v.isNull() & (n > 1))
    end_contrib = (
        F.when(v.isNotNull(), F.when(n > 1, d).otherwise(nxt))
         .when(n == 1, nxt)
         .when(fk | (n > 2), F.greatest(d, nxt))
         .otherwise(nxt))
    return (marked.where(kept)
            .groupBy(*owners, value)
            .agg(F.min(day).alias(start), F.max(end_contrib).alias(end)))


def expand_days(df: DataFrame, start: str, end: str, out: str = "SingleDate",
                keep: Sequence[str] | None = None) -> DataFrame:
    """One row per day of [start, end], both ends included.

    Reversed intervals and NULL bounds give no rows. The explode is narrow (no
    shuffle); output rows = total interval days.
    """
    cols = list(keep) if keep is not None else [c for c in df.columns if c not in (start, end)]
    return as_days(df, start, end).select(*cols, F.explode(day_sequence(start, end)).alias(out))


def split_by_length(df: DataFrame, start: str, end: str, max_days: int,
                    length: str = "Days") -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): a guard before ``expand_days`` against bad interval bounds.
    ``rejected`` holds the rows that would give more than ``max_days`` days, with their
    ``length``; every other row, reversed and open intervals included, is in ``kept``.
    No interval is shortened."""
    days = F.datediff(F.col(end).cast("date"), F.col(start).cast("date")) + 1
    long_ = F.coalesce(days > max_days, F.lit(False))
    return df.where(~long_), df.where(long_).withColumn(length, days)


def resolve_overlaps(df: DataFrame, owner: Keys, start: str, end: str, candidate: str,
                     day: str = "SingleDate") -> DataFrame:
    """Per (owner, day) the highest candidate among the intervals covering the
    day: (owner..., day, candidate)."""
    owners = _keys(owner)
    days = expand_days(df.select(*owners, candidate, start, end), start, end, out=day)
    return resolve_daily(days, owners, day, candidate)


def restrict_owners(df: DataFrame, owner: Keys, owners: DataFrame | None) -> DataFrame:
    """Keep rows whose owner key is in ``owners`` (one column per key column, in
    order); a no-op for ``None``. Left-semi: rows are never multiplied. A number
    of columns other than the key's is an error."""
    if owners is None:
        return df
    keys = _keys(owner)
    if len(owners.columns) != len(keys):
        raise ValueError(f"owners has {len(owners.columns)} columns for {len(keys)} key columns")
    wanted = owners.toDF(*[f"_owner_{i}" for i in range(len(keys))])
    same = [df[k] == wanted[f"_owner_{i}"] for i, k in enumerate(keys)]
    return df.join(wanted, same, "left_semi")


def resolved_ranges(df: DataFrame, owner: Keys, start: str, end: str, candidate: str,
                    day: str = "SingleDate", range_start: str = "RangeStart",
                    range_end: str = "RangeEnd", owners: DataFrame | None = None,
                    method: str = "segments") -> DataFrame:
    """Overlap-free date ranges per (owner, candidate): each day goes to the
    highest covering candidate, then each candidate's days collapse to maximal
    runs. Result: (owner..., candidate, range_start, range_end). ``owners``
    restricts the result to those owner keys, before anything is expanded.

    ``method='segments'`` never materialises days (rows grow with the number of
    intervals times log(length)), see ``resolved_segments``; ``method='days'``
    expands every interval to its days (rows = interval days). Both give the
    same result.
    """
    keys = _keys(owner)
    if method not in ("days", "segments"):
        raise ValueError("method must be 'days' or 'segments'")
    # Owners first, then equal intervals once: only what counts is expanded.
    df = restrict_owners(df, keys, owners)
    df = as_days(df.select(*keys, candidate, start, end), start, end).distinct()
    if method == "segments":
        return resolved_segments(df, keys, start, end, candidate, range_start, range_end)
    won = resolve_overlaps(df, keys, start, end, candidate, day=day)
    return islands(won.where(F.col(candidate).isNotNull()), [*keys, candidate], day,
                   start=range_start, end=range_end, unique=True)


# Day numbers count from the first representable date, so they are never
# negative and a right shift is a floor division.
_DAY_ZERO = "0001-01-01"


def _day_number(col: str):
    return F.datediff(F.col(col), F.to_date(F.lit(_DAY_ZERO)))


def _shift(way: str, value, by):
    return F.call_function(f"shift{way}", value, by)


def _top_bit(value):
    """Place of the highest set bit of a positive number."""
    return F.length(F.bin(value)) - 1


def _day_blocks(iv: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., _j, _k): the cover of the day numbers [_a, _b] by aligned
    blocks [_k * 2**_j, (_k + 1) * 2**_j - 1]: disjoint, at most two of a level.

    With c the middle (the multiple of the highest power of two in (_a, _b + 1]), the
    blocks before c have the sizes of the set bits of _x = c - _a, growing, and those
    after it of _y = _b + 1 - c, shrinking."""
    j = F.col("_j")
    rows = iv.select(*keep, "_a", "_x", "_y",
                     F.explode(F.sequence(F.lit(0), _top_bit(F.col("_x").bitwiseOR(F.col("_y"))))).alias("_j"))
    on = lambda c: _shift("right", F.col(c), j).bitwiseAND(F.lit(1)) == 1
    below = F.col("_x").bitwiseAND(_shift("left", F.lit(1), j) - 1)
    first = _shift("right", F.col("_a") + below, j)
    second = _shift("right", F.col("_a") + F.col("_x") + _shift("left", _shift("right", F.col("_y"), j + 1), j + 1), j)
    return (rows.select(*keep, "_j", F.explode(F.array(F.when(on("_x"), first), F.when(on("_y"), second))).alias("_k"))
            .where(F.col("_k").isNotNull()))


def _winning_segments(df: DataFrame, keys: list[str], start: str, end: str, candidate: str) -> DataFrame:
    """(keys..., _s, _e, candidate): per owner disjoint stretches of day numbers, each
    with the highest candidate of the intervals that cover it (NULL if they have none).

    1. Each interval is covered by at most 46 aligned power-of-two day blocks;
       the highest candidate per (owner, level, block) is a partial aggregate.
    2. The distinct interval edges of an owner (start, end + 1) cut its time
       line into segments; no interval starts or ends inside a segment, so one
       candidate wins all of it.
    3. The winner of a segment is the highest block value over the blocks that
       contain its first day: an equi-join on (owner, level, block). An owner's
       edges carry a bitmap of the levels its blocks have, so only these are
       probed: intervals of up to a month have five levels, not 23.
       The keys include the block, so a hot owner is spread over many tasks.
    """
    iv = (as_days(df, start, end).select(*keys, candidate, _day_number(start).alias("_a"),
                    _day_number(end).alias("_b"))
          .where(F.col("_b") >= F.col("_a")))
    after = F.col("_b") + 1
    step = _top_bit(F.col("_a").bitwiseXOR(after))
    middle = _shift("left", _shift("right", after, step), step)
    iv = iv.withColumn("_x", middle - F.col("_a")).withColumn("_y", after - middle)
    blocks = (_day_blocks(iv, [*keys, candidate])
              .groupBy(*keys, "_j", "_k").agg(F.max(candidate).alias("_m")))
    edges = (iv.select(*keys, F.col("_x").bitwiseOR(F.col("_y")).alias("_l"),
                       F.explode(F.array(F.col("_a"), F.col("_b") + 1)).alias("_p"))
             .groupBy(*keys, "_p").agg(F.bit_or("_l").alias("_l")))
    w = Window.partitionBy(*keys)
    segments = (edges.select(*keys, F.col("_p").alias("_s"),
                             (F.lead("_p").over(w.orderBy("_p")) - 1).alias("_e"),
                             F.bit_or("_l").over(w).alias("_l"))
                .where(F.col("_e").isNotNull()))
    probes = (segments.select(*keys, "_s", "_e", "_l", F.explode(F.sequence(F.lit(0), _top_bit(F.col("_l")))).alias("_j"))
              .where(_shift("right", F.col("_l"), F.col("_j")).bitwiseAND(F.lit(1)) == 1)
              .select(*keys, "_s", "_e", "_j", _shift("right", F.col("_s"), F.col("_j")).alias("_k")))
    return (probes.join(blocks, [*keys, "_j", "_k"], "inner")
            .groupBy(*keys, "_s", "_e").agg(F.max("_m").alias(candidate)))


def overlap_pieces(df: DataFrame, owner: Keys, start: str, end: str, candidate: str,
                   piece_start: str = "PieceStart", piece_end: str = "PieceEnd") -> DataFrame:
    """``resolve_overlaps`` without days: (owner..., piece_start, piece_end, candidate),
    disjoint pieces whose days are those that some interval of the owner covers, each
    with the highest covering candidate. Rows grow with the intervals' edges,
    not with their length; ``expand_days`` gives the days when they are needed."""
    keys = _keys(owner)
    zero = F.to_date(F.lit(_DAY_ZERO))
    won = _winning_segments(df.select(*keys, candidate, start, end).distinct(), keys, start, end, candidate)
    return won.select(*keys, F.date_add(zero, F.col("_s")).alias(piece_start),
                      F.date_add(zero, F.col("_e")).alias(piece_end), candidate)


def resolved_segments(df: DataFrame, owner: Keys, start: str, end: str, candidate: str,
                      range_start: str = "RangeStart", range_end: str = "RangeEnd") -> DataFrame:
    """``resolved_ranges`` without expanding days: the winning segments of each
    owner, adjacent ones with the same winner merged (a window per owner and
    candidate over segments, bounded by the owner's distinct edge dates)."""
    keys = _keys(owner)
    won = _winning_segments(df.where(F.col(candidate).isNotNull()), keys, start, end, candidate)
    w2 = Window.partitionBy(*keys, candidate).orderBy("_s")
    prev_e = F.lag("_e").over(w2)
    new_run = F.when(prev_e.isNull() | (F.col("_s") > prev_e + 1), 1).otherwise(0)
    runs = won.withColumn("_new", new_run).withColumn(
        "_run", F.sum("_new").over(w2.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    zero = F.to_date(F.lit(_DAY_ZERO))
    return (runs.groupBy(*keys, candidate, "_run")
            .agg(F.min("_s").alias("_rs"), F.max("_e").alias("_re"))
            .select(*keys, candidate, F.date_add(zero, F.col("_rs")).alias(range_start),
                    F.date_add(zero, F.col("_re")).alias(range_end)))


def daily_ranges(df: DataFrame, owner: Keys, day: str, candidate: str,
                 range_start: str = "RangeStart", range_end: str = "RangeEnd") -> DataFrame:
    """Dated assignments -> one candidate per (owner, day) -> ranges per
    (owner, candidate). The roster form of ``resolved_ranges``."""
    owners = _keys(owner)
    won = resolve_daily(df.where(F.col(day).isNotNull()), owners, day, candidate)
    return islands(won.where(F.col(candidate).isNotNull()), [*owners, candidate], day,
                   start=range_start, end=range_end, unique=True)

