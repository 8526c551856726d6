"""DataFrame helpers: row keys, exact positions in a total order, interval joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rota.session import cut_lineage

ID, KEY = "_id", "_key"


def keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(``_id``, ``_key``, more...): the id and a 64-bit hash of the text. The
    pair names a row's content; rows that agree in both are repeats."""
    return docs.select(F.col(id_col).alias(ID), text_key(text_col).alias(KEY), *more)


def text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def meet(left: DataFrame, right: DataFrame, how: str = "left", id_col: str = ID,
         key_col: str = KEY, extra=None) -> DataFrame:
    """Join on (id, text key), null-safe in the id; ``right`` has ``_id`` and ``_key``,
    which the result leaves out, and columns that ``left`` doesn't have. ``extra``
    gets the renamed right side and returns a further condition."""
    rid, rkey = fresh(left, "_right_id", "_right_key")
    right = right.select(F.col(ID).alias(rid), F.col(KEY).alias(rkey),
                         *[F.col(c).alias(c) for c in right.columns if c not in (ID, KEY)])
    same = (F.col(key_col) == F.col(rkey)) & F.col(id_col).eqNullSafe(F.col(rid))
    met = left.join(right, same if extra is None else same & extra(right), how)
    return met if how in ("left_semi", "left_anti") else met.drop(rid, rkey)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names`` changed, where needed, so that none is a column of ``df``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def keep_rows(docs: DataFrame, kept: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of ``docs`` whose (id, text) is in ``kept`` (``_id``, ``_key``), all
    columns kept; of repeats of one (id, text) a single row stays."""
    (key,) = fresh(docs, "_text_key")
    wide = docs.withColumn(key, text_key(text_col))
    found = meet(wide, kept.select(ID, KEY).distinct(), "left_semi", id_col, key)
    return found.dropDuplicates([id_col, key]).drop(key)


def positions(df: DataFrame, order: Sequence[str], out: str = "_pos",
              weight: str | None = None) -> DataFrame:
    """Adds ``out``: the row's exact 0-based place in the order of ``order`` (with
    ``weight``: the sum of that column over the rows before it).

    The rows are range-partitioned and sorted in parallel, and frozen with
    their partition number and place in it; only one count per partition is
    gathered, so no task sees more than its own range. Give an order that ends
    in a near-unique column: equal rows meet in one partition.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col(c).asc_nulls_last() for c in order]
    placed = (df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
              .withColumn("_part", F.spark_partition_id())
              .withColumn("_at", F.monotonically_increasing_id().bitwiseAND(
                  F.lit((1 << 33) - 1))))
    placed = cut_lineage(placed)
    size = F.sum(weight) if weight else F.count(F.lit(1))
    sizes = placed.groupBy("_part").agg(size.cast("long").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per shuffle partition: bounded by that setting, so broadcast.
    starts = F.broadcast(sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")))
    if weight:
        inside = Window.partitionBy("_part").orderBy("_at").rowsBetween(
            Window.unboundedPreceding, -1)
        placed = placed.withColumn("_at", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return (placed.join(starts, "_part")
            .withColumn(out, (F.col("_start") + F.col("_at")).cast("long"))
            .drop("_part", "_at", "_start"))
