"""Benchmark decontamination by greedy string tiling.

A document is contaminated by a benchmark item when tiles - non-overlapping
runs of at least ``MIN_TILE`` words that stand in both - cover at least
``COVERAGE`` of the item's words. The tiles may stand in any order in the
document, so a reordered passage is found too.

Documents meet items through shared five-word windows (seeds). The words of an
item under its seeds bound its tile coverage from above, so pairs below the
threshold go unseen; the rest are tiled: from long window lengths to short
ones, Karp-Rabin hashes of unmarked windows find matches, the longest are
marked first.

The items are the stated query set: they are read in blocks of a bounded number
of words, each block is broadcast and meets every document in one scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rota.llm.frames import ID, KEY, fresh, keyed, meet, text_key
from rota.llm.words import WordHashes, alnum_words, rolling

MIN_TILE = 5
COVERAGE = 0.8
BLOCK_BYTES = 16 << 20   # text of the items broadcast at once
HITS = "array<struct<item_id:bigint,coverage:double>>"


def tiles(doc: np.ndarray, item: np.ndarray, minimum: int = MIN_TILE) -> list[tuple[int, int, int]]:
    """Greedy tiling of two hash sequences: (start in doc, start in item, length).

    One pass at search length s finds every unmarked window of s words that both
    have, extends it to a maximal unmarked match and marks the matches from the
    longest down, leaving out those that a longer one has covered in part; the
    pass is repeated until nothing of length s is left, then s shrinks.
    """
    done_d, done_i = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    found: list[tuple[int, int, int]] = []
    s = min(len(item), len(doc))
    while s >= minimum:
        table: dict[int, list[int]] = {}
        own = rolling(item, s)
        for p in _free(done_i, s).tolist():
            table.setdefault(int(own[p]), []).append(p)
        matches = []
        if table:
            values = rolling(doc, s)
            free = _free(done_d, s)
            near = free[np.isin(values[free], np.fromiter(table, np.uint64, len(table)))]
            for d in near.tolist():
                for i in table[int(values[d])]:
                    n = _extent(doc, item, done_d, done_i, d, i)
                    if n >= s:
                        matches.append((-n, d, i))
        marked = False
        for n, d, i in sorted(matches):
            n = -n
            if not (done_d[d:d + n].any() or done_i[i:i + n].any()):
                done_d[d:d + n] = done_i[i:i + n] = True
                found.append((d, i, n))
                marked = True
        if not marked:
            s = s // 2 if s // 2 > minimum else s - 1 if s <= minimum else minimum
    return found


def _free(done: np.ndarray, s: int) -> np.ndarray:
    """Starts of windows of s positions without a marked one."""
    if len(done) < s:
        return np.zeros(0, np.int64)
    sums = np.concatenate(([0], np.cumsum(done)))
    return np.flatnonzero(sums[s:] == sums[:-s])


def _extent(doc, item, done_d, done_i, d: int, i: int) -> int:
    n = min(len(doc) - d, len(item) - i)
    same = (doc[d:d + n] == item[i:i + n]) & ~done_d[d:d + n] & ~done_i[i:i + n]
    return n if same.all() else int(np.argmin(same))


class Items:
    """One block of items, ready to meet documents."""

    def __init__(self, rows: list[tuple[int, str]]):
        cache = WordHashes()
        self.ids, self.words, seeds = [], [], {}
        self.short: dict[int, dict[int, list[int]]] = {}   # words -> hash of them all -> ids
        for item_id, text in rows:
            hashes = cache.of(alnum_words((text or "").encode()))
            if len(hashes) < MIN_TILE:
                for h in rolling(hashes, len(hashes)).tolist() if len(hashes) else ():
                    self.short.setdefault(len(hashes), {}).setdefault(h, []).append(item_id)
                continue
            for p, h in enumerate(rolling(hashes, MIN_TILE).tolist()):
                seeds.setdefault(h, []).append((len(self.ids), p))
            self.ids.append(item_id)
            self.words.append(hashes)
        self.seeds = seeds
        self.sorted = np.sort(np.fromiter(seeds, np.uint64, len(seeds)))
        self.gate = np.zeros(1 << 16, bool)
        self.gate[(self.sorted >> np.uint64(48)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray, coverage: float) -> list[tuple[int, float]]:
        out = [(i, 1.0) for size, whole in self.short.items()
               for h in whole.keys() & set(rolling(hashes, size).tolist()) for i in whole[h]]
        values = rolling(hashes, MIN_TILE)
        maybe = values[self.gate[(values >> np.uint64(48)).astype(np.int64)]]
        if len(maybe):
            out += self._tiled(hashes, maybe, coverage)
        # Once for equal rows, a NULL id first, as Spark orders them.
        return sorted(set(out), key=lambda hit: (hit[0] is not None, hit[0] or 0, hit[1]))

    def _tiled(self, hashes: np.ndarray, maybe: np.ndarray, coverage: float) -> list[tuple[int, float]]:
        at = np.minimum(np.searchsorted(self.sorted, maybe), len(self.sorted) - 1)
        under: dict[int, set[int]] = {}
        for h in set(maybe[self.sorted[at] == maybe].tolist()):
            for item, p in self.seeds[h]:
                under.setdefault(item, set()).update(range(p, p + MIN_TILE))
        out = []
        for item, covered in under.items():
            size = len(self.words[item])
            if len(covered) < coverage * size:
                continue
            share = sum(n for _, _, n in tiles(hashes, self.words[item])) / size
            if share >= coverage:
                out.append((self.ids[item], share))
        return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str,
            limit: int = BLOCK_BYTES) -> list[list[tuple[int, str]]]:
    """The items in blocks of about ``limit`` bytes of text, one at a time."""
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = -(-total // limit) or 1
    for b in range(n):
        rows = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()
        yield n, [(r["i"], r["t"]) for r in rows]


def _hits_column(spark, rows: list[tuple[int, str]], text_col: str, coverage: float) -> Column:
    shared = spark.sparkContext.broadcast(rows)

    @F.pandas_udf(HITS)
    def hits(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        items, cache = Items(shared.value), WordHashes()
        for batch in texts:
            yield pd.Series([
                [{"item_id": i, "coverage": c} for i, c in
                 items.hits(cache.of(alnum_words(bytes(t))), coverage)] if t is not None else []
                for t in batch])
    return hits(F.col(text_col).cast("binary"))


def contamination(docs: DataFrame, benchmark: DataFrame, out: str = "hits",
                  text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id",
                  item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with ``out``: the items that contaminate the row and their tile
    coverage, by item id; empty for none, for an empty or NULL text and for an
    empty benchmark. Words are lower-cased runs of letters and digits. Items of
    fewer than five words are one tile, found as whole copies. Repeated items count once each."""
    spark, blocks = docs.sparkSession, None
    for n, rows in _blocks(benchmark, item_col, item_text):
        column = _hits_column(spark, rows, text_col, coverage)
        if n == 1:
            return docs.withColumn(out, column)
        found = keyed(docs, id_col, text_col, column.alias("_hits")).where("size(_hits) > 0")
        found = found.select(ID, KEY, F.explode("_hits").alias("_hit"))
        blocks = found if blocks is None else blocks.unionAll(found)
    per_row = blocks.distinct().groupBy(ID, KEY).agg(F.array_sort(F.collect_list("_hit")).alias("_hits"))
    key, hits = fresh(docs, "_text_key", "_hits")
    met = meet(docs.withColumn(key, text_key(text_col)), per_row.withColumnRenamed("_hits", hits),
               "left", id_col, key)
    return met.withColumn(out, F.coalesce(hits, F.array().cast(HITS))).drop(key, hits)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **names) -> DataFrame:
    """The rows of ``docs`` that no item contaminates, all columns kept."""
    (hits,) = fresh(docs, "_hits_of_items")
    return contamination(docs, benchmark, out=hits, **names).where(F.size(hits) == 0).drop(hits)
