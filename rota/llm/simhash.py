"""SimHash near-duplicates through an index of positional bytes.

A text becomes a 64-bit fingerprint; texts whose fingerprints differ in at most
``max_bits`` (4) bits are linked. Such a pair differs in at most 4 of the 8
bytes, so it shares at least 4 bytes position by position. The index lists
fingerprints under positional bytes, a pair's shared bytes are tallied, pairs
below the guaranteed minimum of 4 go, and the rest are verified bit by bit.

A list under one byte alone would hold 1/256 of everything, so a list is kept
under three bytes at a time. The 20 byte triples are chosen so that any 4 of
the 8 positions contain one of them whole (Turan's system for 8, 4, 3): a pair
with the minimum of 4 shared bytes always meets in some list.

Only distinct fingerprints are indexed. A short list is joined with itself; a
long one (a large group of near copies) is cut into pieces, and each pair of
pieces goes to a task that keeps a spanning forest of its links, never all
pairs. Either way exactly the links of the definition decide.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rota.llm.frames import ID, KEY, keep_rows, keyed
from rota.llm.graph import components
from rota.llm.words import split_words
from rota.session import cut_lineage

WIDTH, MAX_BITS, SHARED = 4, 4, 4
LONG = 64        # a list of more fingerprints than this is dealt out in pieces
PIECE = 2048     # fingerprints in a piece, so a task holds two of these at most

# Positions 0-7 in three classes; triples inside a class, or two of one class
# with one of the next.
_CLASS = (0, 0, 0, 1, 1, 1, 2, 2)
TRIPLES = [t for t in combinations(range(8), 3)
           if len({_CLASS[i] for i in t}) == 1
           or any(sorted(_CLASS[i] for i in t) == sorted((c, c, (c + 1) % 3)) for c in range(3))]


def fingerprint(words: list[bytes], width: int = WIDTH, chunk: int = 1 << 16) -> int:
    """A bit is set when over half of the hashes of the ``width``-word shingles
    have it; a shorter text is one shingle, no words give 0. Signed 64 bits."""
    if not words:
        return 0
    text = b" ".join(words)
    gaps = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    first = np.concatenate(([0], gaps + 1))
    last = np.concatenate((gaps, [len(text)]))
    n = max(len(words) - width + 1, 1)
    first, last = first[:n].tolist(), last[len(last) - n:].tolist()
    ones, h64 = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for i in range(0, n, chunk):
        part = [h64(text[a:b], 42) for a, b in zip(first[i:i + chunk], last[i:i + chunk])]
        raw = np.array(part, "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 width: int = WIDTH) -> DataFrame:
    """(``_id``, ``_key``, ``fp``) of every row; A-Z count as a-z."""
    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                fps = [fingerprint(split_words(t.lower()) if t else [], width)
                       for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(fps, pa.int64())],
                    names=[ID, KEY, "fp"])

    rows = keyed(docs, id_col, text_col, F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(signed, f"{ID} long, {KEY} long, fp long")


def _byte(fp: Column, i: int) -> Column:
    return F.shiftrightunsigned(fp, 8 * i).bitwiseAND(F.lit(255))


def _shares(a: Column, b: Column, i: int) -> Column:
    return _byte(a.bitwiseXOR(b), i) == 0


def _forest(group: pd.DataFrame) -> pd.DataFrame:
    """Links that join every fingerprint of the group to those it reaches."""
    left = np.unique(group["fp"].to_numpy()).view(np.uint64)
    out, queue = [], []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = np.bitwise_count(left ^ at) <= MAX_BITS
        if near.any():
            found = left[near]
            out.append(np.stack([np.full(len(found), at), found], 1))
            queue.extend(found)
            left = left[~near]
    pairs = np.concatenate(out) if out else np.zeros((0, 2), np.uint64)
    return pd.DataFrame({"a": pairs[:, 0].view(np.int64) if len(pairs) else [],
                         "b": pairs[:, 1].view(np.int64) if len(pairs) else []}, dtype="int64")


def links(fps: DataFrame) -> DataFrame:
    """(a, b) with the same connected components as all pairs of distinct
    values in ``fp`` that differ in at most 4 bits."""
    fp = F.col("fp")
    # An empty list number would repeat bits of the bytes: number | byte | byte | byte.
    keys = F.array(*[
        F.lit(n << 24) + _byte(fp, i) * 65536 + _byte(fp, j) * 256 + _byte(fp, k)
        for n, (i, j, k) in enumerate(TRIPLES)])
    entries = fps.select("fp", F.explode(keys).alias("k"))
    sizes = entries.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = cut_lineage(entries.join(sizes, "k"))

    short = shared.where(F.col("n") <= LONG).select("k", "fp")
    one, two = short.alias("one"), short.alias("two")
    pairs = one.join(two, (F.col("one.k") == F.col("two.k"))
                     & (F.col("one.fp") < F.col("two.fp"))).select(
        F.col("one.k").alias("k"), F.col("one.fp").alias("a"), F.col("two.fp").alias("b"))
    a, b = F.col("a"), F.col("b")
    tally = sum((_shares(a, b, i).cast("int") for i in range(8)), F.lit(0))
    near = (tally >= SHARED) & (F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)
    short_links = pairs.where(near).select("a", "b")

    pieces = F.ceil(F.col("n") / PIECE).cast("int")
    dealt = (shared.where(F.col("n") > LONG)
             .withColumn("c", pieces)
             .withColumn("p", F.pmod(F.xxhash64("fp"), F.col("c")).cast("int"))
             .withColumn("q", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
             .where((F.col("q") != F.col("p")) | (F.col("c") == 1))
             .select("k", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "fp"))
    long_links = dealt.groupBy("k", "p", "q").applyInPandas(_forest, "a long, b long")
    return short_links.unionAll(long_links)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       width: int = WIDTH) -> DataFrame:
    """One row per input row: ``_id``, ``_key``, ``fp``, ``root`` (the component's
    smallest fingerprint) and ``component_id``, the smallest id reachable over
    links (NULL only if every id there is NULL). Texts without words have
    fingerprint 0 and are linked like any other."""
    rows = cut_lineage(fingerprints(docs, id_col, text_col, width))
    classes = rows.groupBy("fp").agg(F.min(ID).alias("low"))
    roots = components(links(classes.select("fp")))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select(F.col("fp").alias("_fp"), "root", "component_id")
    return rows.join(named, rows["fp"] == named["_fp"], "left").drop("_fp")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id",
                         text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: the smallest id, and of several
    texts under it the one with the smallest text hash. All columns are kept."""
    rows = simhash_components(docs, id_col, text_col)
    best = rows.groupBy("root").agg(F.min(F.struct(
        F.col(ID).isNull().alias("none"), F.col(ID), F.col(KEY))).alias("best"))
    return keep_rows(docs, best.select(f"best.{ID}", f"best.{KEY}"), id_col, text_col)
