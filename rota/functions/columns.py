"""Column expressions shared by the operators.

All of them are plain ``pyspark.sql.functions`` compositions, so they stay
inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bit_and(col: Column | str) -> Column:
    """``MIN(CAST(bit AS TINYINT))``: 1 only when every non-NULL row is set."""
    return F.min(_c(col).cast("tinyint"))


def bit_or(col: Column | str) -> Column:
    """``MAX(CAST(x AS INT))``: 1 when any row is set (or the largest number)."""
    return F.max(_c(col).cast("int"))


def whole_number(col: Column | str) -> Column:
    """``CAST(x AS INT)`` for dirty input: NULL where the cast would fail."""
    return _c(col).try_cast("int")


def refused_casts(df: DataFrame, columns: Sequence[str], kind: str = "int") -> DataFrame:
    """One row per name in ``columns``: (column, refused), the values that ``try_cast`` turns into NULL.
    One aggregate, so that no refused value stays unseen."""
    counts = df.agg(*[F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(kind).isNull()).alias(c)
                      for c in columns])
    return counts.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("refused")) for c in columns])).alias("r")).select("r.*")


def flag_text(col: Column | str) -> Column:
    """``CASE WHEN x = 1 THEN 'true' ELSE 'false' END`` - NULL gives ``'false'``."""
    return F.when(_c(col) == 1, F.lit("true")).otherwise(F.lit("false"))


def day_sequence(start: Column | str, end: Column | str) -> Column:
    """Every day of [start, end], both ends included.

    A reversed interval yields no days (``sequence`` alone would count down),
    a NULL end or start yields NULL; ``explode`` drops both.
    """
    s, e = _c(start), _c(end)
    return F.when(e >= s, F.sequence(s, e))


def sorted_array(*fields: Column | str) -> Column:
    """``collect_list`` of a struct, sorted by its fields in order (NULL fields
    first), so array order is deterministic. Use inside ``agg``."""
    return F.array_sort(F.collect_list(F.struct(*[_c(f) for f in fields])))

