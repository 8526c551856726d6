"""Exact top-k Hamming search with incremental multi-index hashing.

A code is cut into chunks and indexed under the value of each. Chunks are about
as long as the logarithm of an eighth of the number of distinct codes (8 to 24 bits), so
the list of a value holds about ``LISTED`` codes at every size. A probe is a row that is
made, moved and sorted, a code of a list only a comparison inside the join, so lists of a
few codes are cheaper than of one: probes are fewer and shorter radii do. If two codes differ in fewer than m(s + 1) bits, with m chunks, then some
chunk of theirs differs in at most s bits. So a query probes all values within
s bits of its own, chunk by chunk, for s = 0, 1, 2, ...; after round s every code
closer than m(s + 1) has been seen. In the next round c chunks are enough to see
every code closer than m(s + 1) + c, so a query probes only as many as reach its
k-th verified distance, and is done then. Queries that are done leave.
"""

from __future__ import annotations

from itertools import combinations
from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rota.session import cut_lineage

LEAST_BITS, MOST_BITS = 8, 24   # of a chunk
LISTED = 8                      # codes under one value of a chunk, about


def sign_code(vector: Column, dims: int) -> Column:
    """Codes of ``dims`` bits as 64-bit words: bit i is set where component i is
    positive; missing and NULL components and a NULL vector count as 0."""
    words = []
    for lo in range(0, dims, 64):
        word = F.lit(0).cast("bigint")
        for i in range(lo, min(lo + 64, dims)):
            on = F.coalesce(F.get(vector, F.lit(i)) > 0, F.lit(False))
            bit = 1 << (i - lo)
            word = word.bitwiseOR(F.when(on, F.lit(bit - (1 << 64) if bit >> 63 else bit))
                                  .otherwise(F.lit(0)).cast("bigint"))
        words.append(word)
    return F.array(*words)


def _chunks(dims: int, codes: int) -> list[tuple[int, int, int]]:
    """(word, shift, bits) of chunks of near-equal length inside 64-bit words, for an
    index of so many codes."""
    out, length = [], min(max(log2(max(codes, 1)), LEAST_BITS), MOST_BITS)
    for w in range(0, dims, 64):
        bits = min(64, dims - w)
        m = max(round(bits / length), -(-bits // MOST_BITS))
        edge = [bits * i // m for i in range(m + 1)]
        out += [(w // 64, a, b - a) for a, b in zip(edge, edge[1:])]
    return out


def _chunk_values(code: Column, chunks) -> Column:
    return F.array(*[
        F.struct(F.lit(n).alias("chunk"),
                 F.shiftrightunsigned(F.element_at(code, w + 1), shift)
                 .bitwiseAND(F.lit((1 << bits) - 1)).cast("int").alias("value"))
        for n, (w, shift, bits) in enumerate(chunks)])


def _masks(bits: int, s: int) -> list[int]:
    return [sum(1 << i for i in c) for c in combinations(range(bits), s)]


def distance(a: Column, b: Column, dims: int) -> Column:
    words = range(1, -(-dims // 64) + 1)
    return sum((F.bit_count(F.element_at(a, w).bitwiseXOR(F.element_at(b, w))) for w in words), F.lit(0))


def _meet(probes: DataFrame, entries: DataFrame) -> DataFrame:
    return probes.join(entries, (F.col("in_chunk") == F.col("chunk"))
                       & (F.col("probe") == F.col("value")))


def top_k(queries: DataFrame, base: DataFrame, k: int, dims: int) -> DataFrame:
    """(query_id, rank, id, distance): the ``k`` rows of ``base`` nearest to every
    query, nearest first, ties by smaller id (NULL ids last).

    Both frames have (id, code). A base of fewer than ``k`` rows gives all of
    them; repeated queries count once, repeated base rows each. Equal base codes
    are indexed once, with their ``k`` smallest ids (more can't be needed), so a
    code that a third of the rows share is one entry.
    """
    in_code = Window.partitionBy("code").orderBy(F.col("id").asc_nulls_last())
    members = cut_lineage(base.select("id", "code")
                          .withColumn("nth", F.row_number().over(in_code)).where(F.col("nth") <= k)
                          .groupBy("code").agg(F.array_sort(F.collect_list(F.struct(
                              F.col("id").isNull().alias("none"), "id"))).alias("ids")))
    size = members.agg(F.count(F.lit(1)).alias("codes"), F.sum(F.size("ids")).alias("rows")).first()
    chunks = _chunks(dims, size["codes"] // LISTED)
    m, widest = len(chunks), max(bits for _, _, bits in chunks)
    enough = min(k, size["rows"] or 0)
    entries = cut_lineage(members.select(
        "code", F.col("ids")[0]["id"].alias("low"),
        F.explode(_chunk_values(F.col("code"), chunks)).alias("c"))
        .select("code", "low", "c.chunk", "c.value"))
    wanted = queries.select(F.col("id").alias("query_id"), F.col("code").alias("query")).distinct()
    open_ = cut_lineage(wanted.withColumn("need", F.lit(m))   # chunks to probe next
                        .withColumn("bound", F.lit(dims)))     # no farther row can count
    best = None
    for s in range(widest + 1):
        value = F.col("c.value")
        probes = open_.select("query_id", "query", "bound", F.explode(F.slice(
            _chunk_values(F.col("query"), chunks), 1, F.col("need"))).alias("c"))
        masks = F.lit(None).cast("array<int>")
        for width in {bits for _, _, bits in chunks}:
            listed = F.split(F.lit(",".join(map(str, _masks(width, s)))), ",")
            if s <= width:
                of_width = F.col("c.chunk").isin([n for n, c in enumerate(chunks) if c[2] == width])
                masks = F.when(of_width, listed.cast("array<int>")).otherwise(masks)
        probes = (probes.withColumn("mask", F.explode(masks))
                  .select("query_id", "query", "bound", F.col("c.chunk").alias("in_chunk"),
                          value.bitwiseXOR(F.col("mask")).alias("probe")))
        # Verified at once: what lies beyond the k-th distance so far goes no further.
        apart = distance(F.col("query"), F.col("code"), dims)
        found = (_meet(probes, entries).where(apart <= F.col("bound"))
                 .select("query_id", "query", "code", "low", apart.alias("distance")).distinct())
        if best is not None:
            found = found.unionByName(best.join(open_, ["query_id", "query"], "left_semi")
                                      .select(*found.columns)).distinct()
        # The k codes nearest by distance and smallest id hold the k nearest rows.
        reach = Window.partitionBy("query_id", "query").orderBy(
            "distance", F.col("low").asc_nulls_last(), "code")
        found = (found.withColumn("near", F.row_number().over(reach)).where(F.col("near") <= k)
                 .drop("near"))
        settled = None if best is None else best.join(open_, ["query_id", "query"], "left_anti")
        best = cut_lineage(found if settled is None else found.unionByName(settled))
        so_far = Window.partitionBy("query_id", "query").orderBy("distance")
        reached = (best.join(members, "code")
                   .withColumn("rows", F.sum(F.size("ids")).over(so_far))
                   .where(F.col("rows") >= enough)
                   .groupBy(F.col("query_id").alias("qid"), F.col("query").alias("qcode"))
                   .agg(F.min("distance").alias("kth")))
        # Where fewer than m chunks were probed, they reached the k-th distance.
        covered = F.lit(m * (s + 1) - 1)
        left = F.least(F.coalesce(F.col("kth") - covered, F.lit(m)), F.lit(m))
        open_ = cut_lineage(
            open_.join(reached, F.col("query_id").eqNullSafe(F.col("qid"))
                       & (F.col("query") == F.col("qcode")), "left")
            .where((F.col("need") == m) & (left > 0))
            .select("query_id", "query", left.cast("int").alias("need"),
                    F.coalesce("kth", F.lit(dims)).alias("bound")))
        if open_.isEmpty():
            break
    rows = (best.join(members, "code")
            .select("query_id", "query", "distance", F.explode("ids").alias("row"))
            .withColumn("id", F.col("row.id")))
    order = Window.partitionBy("query_id", "query").orderBy(
        "distance", F.col("id").asc_nulls_last())
    return (rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "id", "distance"))
