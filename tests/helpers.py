"""Small-fixture builders and brute-force reference implementations."""

from __future__ import annotations

import datetime as dt
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession

D0 = dt.date(2024, 1, 1)


def day(n: int) -> dt.date:
    return D0 + dt.timedelta(days=n - 1)


def frame(spark: SparkSession, rows, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def rowset(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def brute_islands(rows):
    """rows: (key, day) -> sorted (key, start, end) of maximal consecutive runs."""
    days = defaultdict(set)
    for k, d in rows:
        if d is not None:
            days[k].add(d)
    out = []
    for k, ds in days.items():
        ds = sorted(ds)
        start = prev = ds[0]
        for d in ds[1:]:
            if d > prev + dt.timedelta(days=1):
                out.append((k, start, prev))
                start = d
            prev = d
        out.append((k, start, prev))
    return sorted(out, key=repr)


def brute_change_blocks(rows):
    """Literal LEAD/LAG form over (emp, day, shift) rows ordered by
    (day, shift NULLS FIRST) per emp; grouped per (emp, shift)."""
    by_emp = defaultdict(list)
    for emp, d, s in rows:
        by_emp[emp].append((d, s))
    acc = {}
    for emp, seq in by_emp.items():
        seq.sort(key=lambda x: (x[0], x[1] is not None, x[1] if x[1] is not None else 0))
        for i, (d, s) in enumerate(seq):
            prev = seq[i - 1][1] if i > 0 else None
            kept = prev is None or (s is not None and prev != s)
            if not kept:
                continue
            nxt = seq[i + 1][0] if i + 1 < len(seq) else None
            start, end = acc.get((emp, s), (None, None))
            start = d if start is None else min(start, d)
            if nxt is not None:
                end = nxt if end is None else max(end, nxt)
            acc[(emp, s)] = (start, end)
    return sorted(((e, s, a, b) for (e, s), (a, b) in acc.items()), key=repr)


def brute_resolved_ranges(intervals):
    """intervals: (owner, candidate, from, to) -> (owner, candidate, start, end)."""
    best = {}
    for owner, cand, a, b in intervals:
        if a is None or b is None or b < a:
            continue
        d = a
        while d <= b:
            k = (owner, d)
            if cand is not None and (best.get(k) is None or cand > best[k]):
                best[k] = cand
            elif k not in best:
                best[k] = None
            d += dt.timedelta(days=1)
    won = [((o, c), d) for (o, d), c in best.items() if c is not None]
    return sorted(((k[0], k[1], s, e) for k, s, e in brute_islands(won)), key=repr)
