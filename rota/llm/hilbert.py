"""Sharding by Hilbert-curve order.

Several metadata columns are quantised to a grid, rows are ordered by the
index of their cell on the Hilbert curve, and the order is cut into runs of
equal row counts. Neighbours on the curve are neighbours in every dimension,
so each shard covers a small box of the metadata space and a reader that
filters on any of the columns skips most shards by their min/max.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rota.llm.frames import positions
from rota.session import cut_lineage

BITS = 6   # 64 steps per dimension


def hilbert_index(axes: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Place of every grid point on the Hilbert curve of ``len(axes)``
    dimensions (the transposed-axes form: undo the rotations of each level,
    then Gray-decode, then interleave the bits)."""
    x = [np.asarray(a, np.int64).copy() for a in axes]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    x = [v ^ flip for v in x]
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = (out << 1) | ((v >> b) & 1)
    return out


def quantise(rows: DataFrame, column: str, out: str, total: int, bits: int = BITS) -> DataFrame:
    """Adds ``out``: the step (0 .. 2**bits - 1) of the row's value in an
    equal-depth cut of the column's order. One value is never cut; NULL comes
    last. The values are counted first (partial aggregation), so a value that
    holds a third of the rows is one row of what follows."""
    counts = cut_lineage(rows.groupBy(F.col(column).alias("_value"))
                         .agg(F.count(F.lit(1)).alias("_rows")))
    steps = positions(counts, ["_value"], "_before", weight="_rows").select(
        "_value", F.floor(F.col("_before") * (1 << bits) / F.lit(max(total, 1)))
        .cast("int").alias(out))
    return rows.join(steps, rows[column].eqNullSafe(steps["_value"]), "left").drop("_value")


def hilbert_order(rows: DataFrame, dims: Sequence[str], ties: Sequence[str],
                  bits: int = BITS) -> tuple[DataFrame, int]:
    """``rows`` (short metadata rows, already cut from their text) with
    ``hilbert`` (curve index of the row's cell) and ``_pos`` (exact place in the
    order of curve index, then ``ties``), and the number of rows."""
    total = rows.count()
    for i, dim in enumerate(dims):
        rows = quantise(rows, dim, f"_q{i}", total, bits)

    @F.pandas_udf("long")
    def index(cells: pd.DataFrame) -> pd.Series:
        return pd.Series(hilbert_index([cells[c].to_numpy() for c in cells.columns], bits))

    cells = [f"_q{i}" for i in range(len(dims))]
    rows = rows.withColumn("hilbert", index(F.struct(*cells))).drop(*cells)
    return positions(cut_lineage(rows), ["hilbert", *ties]), total


def hilbert_shards(docs: DataFrame, shards: int, dims: Sequence[str] = ("lang", "source"),
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard assignment under the law ``rows`` (row counts at most one apart).

    The grid is ``dims`` and the size of the text. Result, one row per input
    row: id, size (UTF-8 bytes + 1; 1 for a NULL text), text_crc32, law, shard
    (a run of the curve), slot (gapless from 0 in the shard), grown_shard
    (NULL: rows move between shards when their number changes), hilbert.
    NULLs of a dimension form its last cell. Ties on the curve go by id, then
    size and checksum. Only these numbers are shuffled, never the text.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *[F.col(d).alias(f"_d{i}") for i, d in enumerate(dims)]))
    placed, total = hilbert_order(rows, [*(f"_d{i}" for i in range(len(dims))), "size"],
                                  ["doc_id", "size", "text_crc32"])
    n, k = F.lit(max(total, 1)).cast("long"), F.lit(shards).cast("long")
    shard = F.floor(F.col("_pos") * k / n)
    # floor() of a double is exact only below 2**53; mend by comparing products.
    shard = (shard + F.when((shard + 1) * n <= F.col("_pos") * k, 1).otherwise(0)
             - F.when(shard * n > F.col("_pos") * k, 1).otherwise(0))
    first = F.expr(f"(_shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")
    return (placed.withColumn("_shard", shard.cast("long"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                    F.col("_shard").cast("int").alias("shard"),
                    (F.col("_pos") - first).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard"), "hilbert"))


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id",
                 text_col: str = "text", mode: str = "errorifexists") -> None:
    """Write ``docs`` under ``path``, one folder per shard, in curve order inside
    it (``assigned`` from ``hilbert_shards``). A row finds its place by id and
    checksum of the text; repeats of one (id, text) go together to the first
    of their places."""
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    places = (assigned.groupBy(F.col("doc_id").alias("_pid"), F.col("text_crc32").alias("_pcrc"))
              .agg(F.min(F.struct("shard", "slot")).alias("_place"))
              .select("_pid", "_pcrc", F.col("_place.shard").alias("_shard"),
                      F.col("_place.slot").alias("_slot")))
    joined = docs.join(places, docs[id_col].eqNullSafe(places["_pid"])
                       & (F.crc32(text) == places["_pcrc"]))
    (joined.drop("_pid", "_pcrc")
     .repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot")
     .withColumnRenamed("_shard", "shard").drop("_slot")
     .write.mode(mode).partitionBy("shard").parquet(path))
