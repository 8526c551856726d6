"""Pattern spans in text with DataFrame functions only.

``find_spans`` gives the leftmost non-overlapping matches of a pattern with
their places in code points. Spark's regular expression functions return no
places, so matches are set off by a mark character, the text is split at the
marks, and places are running sums of the lengths of the parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rota.llm.frames import meet

# Two private-use characters; the first in a text is read as the second, which
# no pattern here matches either, so places stay.
MARK, SPARE = "\ue000", "\ue001"
SPAN = "struct<start:bigint,rank:int,kind:string,end:bigint,value:string>"
_STEP = 256


def _folded(values: Column, zero: Column) -> Column:
    """Running sums of an array, one longer than it: 0, v1, v1 + v2, ..."""
    return F.aggregate(values, F.array(zero), lambda acc, v: F.concat(
        acc, F.array(F.element_at(acc, -1) + v)))


def running_sums(values: Column) -> Column:
    """The sum of the elements before each element, over blocks of the array and
    then over the block totals, so that a text with very many matches costs
    little more than its length."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _STEP).cast("int")),
                         lambda b: F.slice(values, b * _STEP + 1, _STEP))
    zero = F.lit(0).cast("bigint")
    inner = F.transform(blocks, lambda b: _folded(b, zero))
    return F.aggregate(
        inner, F.struct(zero.alias("base"), F.array().cast("array<array<bigint>>").alias("sums")),
        lambda acc, block: F.struct(
            (acc["base"] + F.element_at(block, -1)).alias("base"),
            F.concat(acc["sums"], F.array(F.transform(
                F.slice(block, 1, F.size(block) - 1), lambda x: x + acc["base"]))).alias("sums")),
        lambda acc: F.flatten(acc["sums"]))


def mark_matches(df: DataFrame, text: Column, patterns: dict[str, tuple[str, str | None]],
                 out: str = "_parts") -> DataFrame:
    """Adds ``{out}_{name}`` per pattern: the text cut at the edges of its matches
    (text, match, text, match, ..., text), NULL where nothing matches.
    ``patterns``: name -> (Java regular expression, a string without which the
    pattern can't match, or None)."""
    plain = F.coalesce(text, F.lit(""))
    clean = F.when(F.contains(plain, F.lit(MARK)), F.translate(plain, MARK, SPARE)).otherwise(plain)
    df = df.withColumn(f"{out}_", clean)
    for name, (pattern, needed) in patterns.items():
        source = F.col(f"{out}_")
        marked = F.regexp_replace(source, F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}"))
        if needed:
            marked = F.when(F.contains(source, F.lit(needed)), marked)
        df = df.withColumn(f"{out}_{name}", marked)
    for name in patterns:
        marked = F.col(f"{out}_{name}")
        df = df.withColumn(f"{out}_{name}", F.when(F.contains(marked, F.lit(MARK)),
                                                   F.split(marked, MARK)))
    return df.drop(f"{out}_")


def spans_of(parts: Column, starts: Column, kind: str, rank: int) -> Column:
    """Spans (start, rank, kind, end, value) from cut text and its part starts."""
    odd = F.sequence(F.lit(2), F.size(parts) - 1, F.lit(2))
    found = F.transform(odd, lambda i: F.struct(
        F.element_at(starts, i).alias("start"), F.lit(rank).alias("rank"),
        F.lit(kind).alias("kind"),
        (F.element_at(starts, i) + F.length(F.element_at(parts, i))).alias("end"),
        F.element_at(parts, i).alias("value")))
    return F.when(parts.isNotNull(), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def find_spans(df: DataFrame, text: Column, patterns: dict[str, tuple[str, str | None]],
               ranks: dict[str, int]) -> DataFrame:
    """Adds one array of spans per pattern, under its name."""
    df = mark_matches(df, text, patterns)
    names = list(patterns)
    df = df.withColumns({f"_at_{n}": running_sums(
        F.transform(F.col(f"_parts_{n}"), F.length)) for n in names})
    df = df.withColumns({n: spans_of(F.col(f"_parts_{n}"), F.col(f"_at_{n}"), n, ranks[n])
                         for n in names})
    return df.drop(*[f"_parts_{n}" for n in names], *[f"_at_{n}" for n in names])


def by_start(spans: Column) -> Column:
    return F.array_sort(spans)


def by_rank(spans: Column) -> Column:
    """Spans ordered by rank (kind), then start."""
    return F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(
        s["rank"].alias("rank"), s["start"].alias("start"), s.alias("span")))), lambda s: s["span"])


def spans_text(spans: Column) -> Column:
    """kind:start:end of each, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def near(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """Interval join inside documents: rows of ``left`` (``_id``, ``_key``, start,
    end, ...) with each row of ``right`` (``_id``, ``_key``, from, to, ...) that ends
    at most ``radius`` before the start and starts at most ``radius`` after the end.

    Both meet on a cell of ``radius`` code points of their document, so the work
    is dealt out by place, not by document, and a row meets only what its
    surroundings can hold; of the cells that two rows share, the first counts.
    Result: left's columns and right's other than the keys, ``from`` and ``to``.
    """
    def cells(start, end):
        return F.sequence(F.floor(start / radius), F.floor(end / radius))
    wide = cells(F.col("start") - radius, F.col("end") + radius)
    left = left.withColumn("_first", wide[0]).withColumn("_cell", F.explode(wide))
    own = cells(F.col("from"), F.col("to"))
    right = right.withColumn("_right_first", own[0]).withColumn("_right_cell", F.explode(own))
    return meet(left, right, "inner", extra=lambda r: (
        (F.col("_cell") == F.col("_right_cell"))
        & (F.col("_cell") == F.greatest("_first", "_right_first"))
        & (F.col("to") >= F.col("start") - radius) & (F.col("from") <= F.col("end") + radius))).drop(
        "_first", "_cell", "_right_first", "_right_cell", "from", "to")


def redact(text: Column, spans: Column, labels: dict[str, str], other: str) -> Column:
    """``text`` with every span replaced by its kind's label (overlapping spans
    by the label of the first); NULL stays NULL."""
    return _replaced(text, spans, lambda s: _choose(s["kind"], labels, other))


def blank(text: Column, spans: Column) -> Column:
    """``text`` with as many spaces in the place of every span; places stay."""
    return _replaced(text, spans, lambda s: F.repeat(F.lit(" "), (s["end"] - s["start"]).cast("int")))


def _replaced(text: Column, spans: Column, by) -> Column:
    merged = F.aggregate(
        F.array_sort(spans), F.array().cast(f"array<{SPAN}>"),
        lambda acc, s: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] > s["start"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.element_at(acc, -1).withField(
                "end", F.greatest(F.element_at(acc, -1)["end"], s["end"])))))
        .otherwise(F.concat(acc, F.array(s))))
    done = F.aggregate(
        merged, F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.concat(
            F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")),
            by(s)))).alias("out")),
        lambda acc: F.concat(F.array_join(acc["out"], ""),
                             F.substring(text, (acc["at"] + 1).cast("int"), F.lit(2147483647))))
    return F.when(F.size(F.coalesce(spans, F.array().cast(f"array<{SPAN}>"))) > 0, done).otherwise(text)


def _choose(kind: Column, labels: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, label in labels.items():
        out = F.when(kind == name, F.lit(label)).otherwise(out)
    return out
