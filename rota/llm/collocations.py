"""Phrase collocations by SON partitioning: local mining, union, exact global count.

The input's partitions are dealt out to a fixed number of shards. A phrase that
occurs ``support`` times in all must occur ``support / shards`` times in one of
them, so each shard is mined completely at that lowered support, level by level
(a frequent phrase holds frequent shorter ones only). A shard may be any size: its
tasks count by 64-bit hash in chunks of bounded size and Spark sums them. The union
of what is frequent somewhere becomes a bitmap of fixed size, which lets through
every candidate and a few others; a last pass over the texts counts what passes,
by the words themselves, and keeps what reaches the support in all. Hashes and
bitmap thus only save work, the counts are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rota.llm.words import rolling
from rota.session import cut_lineage

SUPPORT, LONGEST, TOP = 100, 5, 2000
SUBSUMED = 100             # a longer phrase with this percentage of the count replaces a candidate
SHARDS = 16
CHUNK_WORDS = 1 << 21      # words a task counts at a time
FILTER_BITS = 26           # the union's bitmap has 2 ** FILTER_BITS bits
NO_LANGUAGE = "und"
FEW_LANGUAGES = 10_000     # up to so many, their totals are broadcast
RANK_PARTS = 64            # parts of a language that are ranked apart first

_BLOCK = 1 << 22           # bytes of text split at a time
# A-Z to a-z, tab to space, the ends of pieces to a byte that UTF-8 text doesn't have.
_END = b"\xff"
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else 0x20 if b == 0x09
               else 0xFF if b in b".,;:!?\n\x0b\x0c\r" else b for b in range(256))


class _Vocabulary(dict):
    """word -> number, counted up; 0 is the end of a piece."""

    def __init__(self):
        super().__init__({_END: 0})
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self.words)
        self.words.append(word)
        return i

    def hashes(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))


def _blocks(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end at a space."""
    start = 0
    while len(text) - start > _BLOCK:
        end = text.find(b" ", start + _BLOCK)
        if end < 0:
            break
        yield text[start:end]
        start = end
    yield text[start:] if start else text


def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[str, np.ndarray, _Vocabulary]]:
    """(lang, word numbers with a 0 after every piece, vocabulary) of (lang, text)
    rows, about ``limit`` words at a time; pieces are never cut."""
    vocabulary, held, size, wait = _Vocabulary(), {}, 0, limit

    def ready(last: bool):
        for lang, parts in held.items():
            ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            ends = np.flatnonzero(ids == 0)
            cut = len(ids) if last else int(ends[-1]) + 1 if len(ends) else 0
            held[lang] = [ids[cut:]] if cut < len(ids) else []
            if cut:
                yield lang, ids[:cut], vocabulary

    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if not text:
                    continue
                parts = held.setdefault(lang, [])
                for block in _blocks(text.translate(_TABLE)):
                    words = block.replace(_END, b" \xff ").split()
                    parts.append(np.fromiter(map(vocabulary.__getitem__, words), np.int32, len(words)))
                    size += len(words)
                    if size >= wait:
                        yield from ready(False)
                        parts = held[lang]
                        size = sum(len(p) for ps in held.values() for p in ps)
                        wait = limit + 2 * size
                        if not size:
                            vocabulary = _Vocabulary()
                parts.append(np.zeros(1, np.int32))
    yield from ready(True)


class _Levels:
    """The phrases of a chunk by length: hashes, and places where they can be frequent.
    ``known``: the bitmap of what is frequent in some shard; it covers the
    lengths up to ``mined``. Longer phrases need both shorter ones inside."""

    def __init__(self, lang: str, ids: np.ndarray, hashes: np.ndarray, known: np.ndarray | None, mined: int):
        self.salt = np.uint64(xxhash.xxh64_intdigest(lang))
        self.ids, self.words, self.known, self.mined = ids, hashes[ids], known, mined

    def of(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, places, hashes there) from 1 word up."""
        may = self.ids != 0
        for k in range(1, longest + 1):
            if k > 1:
                may = may[:-1] & may[1:]
            at = np.flatnonzero(may)
            h = rolling(self.words, k)[at] ^ self.salt
            if k <= self.mined:
                bit = h >> np.uint64(64 - FILTER_BITS)
                on = (self.known[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
                at, h = at[on], h[on]
                may = np.zeros(len(may), bool)
                may[at] = True
            yield k, at, h


def _texts(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang_col), F.lit(NO_LANGUAGE)).alias("lang"),
                       F.col(text_col).cast("binary").alias("text"))


def locally_frequent(texts: DataFrame, lengths: tuple[int, int], known, shards: int, support: int) -> DataFrame:
    """(``hash``): hashes of phrases of the given lengths (first, last) that a shard
    holds ``support`` times. ``known``: broadcast bitmap of all shorter lengths."""
    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() % shards
        bitmap = known.value if known else None
        for lang, ids, vocabulary in _chunks(batches, CHUNK_WORDS):
            levels = _Levels(lang, ids, vocabulary.hashes(), bitmap, lengths[0] - 1)
            for k, _, h in levels.of(lengths[1]):
                if k >= lengths[0]:
                    keys, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), shard, np.int16)),
                         pa.array(n.astype(np.int64))], names=["hash", "shard", "n"])

    counts = texts.mapInArrow(mine, "hash long, shard short, n long")
    return (counts.groupBy("hash", "shard").agg(F.sum("n").alias("n"))
            .where(F.col("n") >= support).select("hash"))


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The bits of the hashes set in Spark, gathered as at most 2 ** (FILTER_BITS - 6)
    64-bit words."""
    bit = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    words = (hashes.groupBy(F.shiftright(bit, 6).cast("int").alias("word"))
             .agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - FILTER_BITS}) & 63 as int))"))
                  .alias("bits")).toArrow())
    out = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return out


def candidate_bitmap(texts: DataFrame, support: int, longest: int, shards: int) -> np.ndarray:
    """Union over the shards of what is frequent there, words first, then pairs, then
    all longer phrases, each level with the levels before as its filter."""
    local, sc = max(math.ceil(support / shards), 1), texts.sparkSession.sparkContext
    found = None
    for lengths in [(1, 1), (2, 2), (3, longest)]:
        if lengths[0] > lengths[1] or lengths[0] > longest:
            continue
        known = sc.broadcast(found) if found is not None else None
        more = _bitmap(locally_frequent(texts, lengths, known, shards, local))
        found = more if found is None else found | more
        if known:
            known.unpersist()
    return found


def counted(texts: DataFrame, candidates: np.ndarray, longest: int) -> DataFrame:
    """(lang, size, phrase, n): how often each phrase of the bitmap occurs, exactly;
    with size 0 and an empty phrase the words of the language."""
    known = texts.sparkSession.sparkContext.broadcast(candidates)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, ids, vocabulary in _chunks(batches, CHUNK_WORDS):
            words, hashes = vocabulary.words, vocabulary.hashes()
            levels = _Levels(lang, ids, hashes, known.value, longest)
            # A phrase's number: that of the phrase without its last word, and that
            # word. Exact, unlike its hash.
            number = np.zeros(len(ids), np.int64)
            yield _rows(lang, 0, [b""], [int(np.count_nonzero(ids))])
            for k, at, _ in levels.of(longest):
                pairs = number[at] * len(words) + ids[at + k - 1]
                _, first, number_at, n = np.unique(pairs, return_index=True, return_inverse=True, return_counts=True)
                number[at] = number_at
                shown = [b" ".join([words[w] for w in ids[i:i + k].tolist()]) for i in at[first].tolist()]
                yield _rows(lang, k, shown, n)

    rows = texts.mapInArrow(count, "lang string, size int, phrase string, n long")
    return rows.groupBy("lang", "size", "phrase").agg(F.sum("n").alias("n"))


def _rows(lang: str, size: int, phrases: list[bytes], n) -> pa.RecordBatch:
    m = len(phrases)
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * m, pa.string()), pa.array([size] * m, pa.int32()),
         pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())],
        names=["lang", "size", "phrase", "n"])


def _part(words: Column, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT,
                 longest: int = LONGEST, top: int | None = TOP, subsumed: int = SUBSUMED,
                 shards: int = SHARDS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): phrases of 2 to ``longest`` words that
    occur ``support`` times or more in a language, by score.

    A-Z are read as a-z; texts end in pieces at ``. , ; : ! ?`` and line ends
    (0x0A-0x0D), pieces in words at spaces and tabs. ``a`` counts all
    occurrences inside pieces, overlaps included, ``n`` all words of the
    language. The cut of a phrase in two parts (``l`` and ``r`` times) with the lowest
    score floor(1000 a n / (l r)) counts, the shortest first part of a tie. A phrase
    that stands inside a longer one with ``subsumed`` percent of its
    occurrences or more goes. ``top`` (None: all) per language by score and ``a``
    falling, then phrase by its UTF-8 bytes.

    A NULL language is ``und``, a NULL text empty; repeated rows count each time;
    ids and other columns are not read. An empty table gives an empty result.
    """
    texts = _texts(docs, text_col, lang_col)
    counts = cut_lineage(counted(texts, candidate_bitmap(texts, support, longest, shards), longest)
                         .where((F.col("size") == 0) | (F.col("n") >= support)))
    totals = counts.where("size = 0").select("lang", F.col("n").alias("total"))
    phrases = counts.where("size > 0").select("lang", "size", "phrase", F.col("n").alias("a"))
    long_ = phrases.where("size > 1").withColumn("words", F.split("phrase", " "))

    size = F.col("size")
    cuts = (long_.withColumn("k", F.explode(F.sequence(F.lit(1), size - 1)))
            .select("lang", "phrase", "a", "k", _part(F.col("words"), F.lit(1), F.col("k")).alias("left"),
                    _part(F.col("words"), F.col("k") + 1, size - F.col("k")).alias("right")))
    known = lambda part, n: phrases.select("lang", F.col("phrase").alias(part), F.col("a").alias(n))
    cuts = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"])
    if totals.count() <= FEW_LANGUAGES:
        totals = F.broadcast(totals)
    cuts = cuts.join(totals, "lang").withColumn("score", _score())
    best = cuts.groupBy("lang", "phrase").agg(
        F.min(F.struct("score", "k", "l", "r", "a", F.col("total").alias("n"))).alias("b"))

    inside = (long_.where("size > 2")
              .withColumn("m", F.explode(F.sequence(F.lit(2), size - 1)))
              .withColumn("s", F.explode(F.sequence(F.lit(1), size - F.col("m") + 1)))
              .select("lang", _part(F.col("words"), F.col("s"), F.col("m")).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    kept = (best.join(inside, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("b.a") * subsumed)))
    order = [F.desc("b.score"), F.desc("b.a"), F.asc("phrase")]
    if top is not None:
        # The first of every part of a language hold the first of the language.
        part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
        first = F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))
        kept = kept.withColumn("part", part).withColumn("first", first).where(F.col("first") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase",
                         *[F.col(f"b.{c}").alias(c) for c in ("a", "l", "r", "n", "score")])


def _score() -> Column:
    """floor(1000 a n / (l r)) in whole decimals: 38 digits hold both products."""
    return F.expr("(cast(a as decimal(15,0)) * cast(total as decimal(18,0)) * cast(1000 as decimal(4,0)))"
                  " div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
