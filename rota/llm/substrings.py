"""Substring removal by hashes of every fixed-length word window.

A window (``width`` consecutive words of one document) is repeated when its
words also start a window in a document with a smaller id. Words covered by a
repeated window go; overlapping windows merge into maximal intervals.

Windows outnumber documents a few hundred to one, so what moves is kept small:

1. each task hashes all windows of a slice of documents (two Rabin-Karp values),
   keeps per hash only the smallest id of the slice - a passage that a third of
   all documents share leaves a task once, not once per document - and sends
   one packed array of hashes per bucket of the hash space;
2. each bucket, dealt out by Spark, finds the smallest id of each hash over
   all slices and tells those documents that must drop it, and that first one;
3. the told documents hash the words of these windows anew and send this check
   to one place per window, where unequal checks show a collision;
4. windows that collided go out as words, are grouped by them, and the smallest
   id of each decides;
5. the answers meet their documents, which drop the covered words.

A bucket is chosen by one hash and its array carries 40 bits of the other: enough
to find candidates. What decides is the check of the words, 64 bits beside these,
and the words themselves wherever checks differ. The number of buckets
follows from the bytes of all texts, so a bucket's share stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rota.llm.words import ODD, WordHashes, rolling, split_words

WIDTH = 13
SLICE = 600_000     # words hashed at a time; also the words of a long text in one go
BUCKET_BYTES = 4 << 20   # bytes of text whose windows share a bucket, on average
NO_ID = (1 << 63) - 1   # stands for a NULL id: larger than every id

LATE, FIRST = -1, -2    # in place of a bucket: windows a slice has settled

_SENT = "bucket int, ids binary, hashes binary"
_TOLD = "id long, tag long, late boolean"
_CLAIM = "lane int, ids binary, keys binary, checks binary"
_CLASH = "id long, key long"


def _window_keys(words: list[bytes], cache: WordHashes, width: int,
                 buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, 40-bit hash) of every window, long texts in overlapping parts."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32   # 16 bits sort faster
    at, low = [], []
    for i in range(0, max(len(words) - width + 1, 0), SLICE):
        hashes = cache.of(words[i:i + SLICE + width - 1])
        at.append((rolling(hashes, width, ODD[1]) % np.uint64(buckets)).astype(kind))
        low.append(rolling(hashes, width, ODD[0]) >> np.uint64(24))
    if not at:
        return np.zeros(0, kind), np.zeros(0, np.uint64)
    return np.concatenate(at), np.concatenate(low)


def _pack(ids: np.ndarray, hashes: np.ndarray, size: int = 5) -> tuple[bytes, bytes]:
    """Ids as runs (differences and lengths, compressed), hashes as ``size`` bytes each."""
    cut = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
    runs = np.diff(np.append(cut, len(ids)))
    heads = ids[cut]
    table = np.stack([np.concatenate((heads[:1], np.diff(heads))), runs]).astype("<i8")
    raw = np.ascontiguousarray(table.view(np.uint8).reshape(2, -1, 8).transpose(0, 2, 1))
    return (pa.compress(raw.tobytes(), codec="zstd", asbytes=True),
            np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size])
            .tobytes())


def _unpack(ids: bytes, hashes: bytes, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    n = len(hashes) // size
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :size] = np.frombuffer(hashes, np.uint8).reshape(n, size)
    codec = pa.input_stream(pa.py_buffer(ids), compression="zstd")
    raw = np.frombuffer(codec.read(), np.uint8)
    table = np.ascontiguousarray(raw.reshape(2, 8, -1).transpose(0, 2, 1)).view("<i8")[..., 0]
    return np.repeat(np.cumsum(table[0]), table[1]), wide.view("<u8")[:, 0]


def _sender(width: int, buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        held: list[tuple[int, np.ndarray, np.ndarray]] = []

        def flush():
            held.sort(key=lambda x: x[0])
            ids = np.repeat(np.array([i for i, _, _ in held], np.int64),
                            [len(b) for _, b, _ in held])
            at = np.concatenate([b for _, b, _ in held])
            low = np.concatenate([h for _, _, h in held])
            held.clear()
            # By hash, then id: the first of a run of equal windows has the smallest id.
            order = np.argsort(low, kind="stable")
            a, h, d = at[order], low[order], ids[order]
            head = np.concatenate(([True], (a[1:] != a[:-1]) | (h[1:] != h[:-1])))
            first = d[np.maximum.accumulate(np.where(head, np.arange(len(d)), 0))]
            rows = []
            # Ids that a smaller one of this slice already beats: the answer is
            # known here, and so is the document it rests on.
            late = np.flatnonzero(d != first)
            for kind, owner in ((LATE, d[late]), (FIRST, first[late])):
                if len(late):
                    owner, tags = _distinct(owner, _tags(a[late], h[late]))
                    rows.append((kind, *_pack(owner, tags, 8)))
            stays = np.zeros(len(at), bool)
            stays[order[head]] = True
            keep = np.flatnonzero(stays)
            keep = keep[np.argsort(at[keep], kind="stable")]
            a, h, d = at[keep], low[keep], ids[keep]
            cut = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
            for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(a)).tolist()):
                rows.append((int(a[lo]), *_pack(d[lo:hi], h[lo:hi])))
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()),
                 pa.array([r[1] for r in rows], pa.binary()),
                 pa.array([r[2] for r in rows], pa.binary())], names=["bucket", "ids", "hashes"])

        size = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    b, h = _window_keys(split_words(text), cache, width, buckets)
                    if len(b):
                        held.append((NO_ID if doc is None else doc, b, h))
                        size += len(b)
                    if size >= SLICE:
                        yield flush()
                        size = 0
        if held:
            yield flush()
    return send


def _tags(at: np.ndarray, low: np.ndarray) -> np.ndarray:
    """One number for a window, to find it again among those of its document."""
    return low << np.uint64(24) | at.astype(np.uint64) & np.uint64((1 << 24) - 1)


def _distinct(*by: np.ndarray) -> list[np.ndarray]:
    """The distinct rows of some columns, in order."""
    order = np.lexsort(by[::-1])
    by = [x[order] for x in by]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in by:
        new[1:] |= x[1:] != x[:-1]
    return [x[new] for x in by]


def _keys(tags: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """(lane, 48-bit key) under which the checks of a window meet."""
    h = tags * np.uint64(ODD[0])
    h ^= h >> np.uint64(31)
    h *= np.uint64(ODD[1])
    return ((h >> np.uint64(8)) % np.uint64(lanes)).astype(np.int32), h >> np.uint64(16)


def _names(lane: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One number for a lane and a key in it."""
    return key ^ (lane.astype(np.uint64) << np.uint64(48))


def _settle(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """One bucket: documents that must drop a window, and the first one of each."""
    parts = [_unpack(i, h) for i, h in zip(group["ids"], group["hashes"])]
    ids = np.concatenate([p[0] for p in parts])
    low = np.concatenate([p[1] for p in parts])
    order = np.lexsort((ids, low))
    ids, low = ids[order], low[order]
    head = np.concatenate(([True], low[1:] != low[:-1]))
    first = ids[np.maximum.accumulate(np.where(head, np.arange(len(ids)), 0))]
    late = ids != first
    beaten, of = _distinct(first[late], low[late])
    tags = _tags(np.full(int(late.sum()) + len(of), key[0], np.uint32), np.append(low[late], of))
    return pd.DataFrame({"id": np.append(ids[late], beaten), "tag": tags.view(np.int64),
                         "late": np.arange(len(tags)) < late.sum()})


def _tell(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """``_settle`` for the rows of a bucket; what slices have settled as it is."""
    out = []
    for kind in (LATE, FIRST):
        for i, h in group.loc[group["bucket"] == kind, ["ids", "hashes"]].itertuples(index=False):
            ids, tags = _unpack(i, h, 8)
            out.append(pd.DataFrame({"id": ids, "tag": tags.view(np.int64), "late": kind == LATE}))
    rest = group[group["bucket"] >= 0]
    if len(rest):
        out.append(_settle(key, rest))
    return pd.concat(out)


def told_windows(docs: DataFrame, id_col: str, text_col: str, width: int,
                 buckets: int) -> DataFrame:
    """(id, tag, late): windows that the document must drop by their hashes (``late``), and
    windows of the document that others drop; NULL ids under ``NO_ID``."""
    sent = (docs.select(F.col(id_col).cast("long").alias("id"),
                        F.col(text_col).cast("binary").alias("t"))
            .mapInArrow(_sender(width, buckets), _SENT))
    # One pass over the texts: what slices have settled travels with the rest,
    # dealt out by its content.
    lane = F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("ids"), F.lit(buckets)).cast("int")
                  ).otherwise(F.col("bucket"))
    return sent.withColumn("lane", lane).groupBy("lane").applyInPandas(_tell, _TOLD)


def _longs(cell: pa.ListScalar) -> np.ndarray:
    return cell.values.to_numpy() if cell.is_valid else np.zeros(0, np.int64)


def _windows(words: list[bytes], starts: np.ndarray, width: int) -> list[memoryview]:
    """The words of the windows at ``starts``, joined by one space."""
    text = memoryview(b" ".join(words))
    edge = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)))
    return [text[a:b - 1] for a, b in zip(edge[starts].tolist(), edge[starts + width].tolist())]


def _claimer(width: int, buckets: int, lanes: int):
    """Checks of the words of all told windows, packed by lane."""
    def claim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        held: list[tuple[np.ndarray, ...]] = []

        def flush():
            ids, lane, key, check = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((ids, lane))
            ids, lane, key, check = ids[order], lane[order], key[order], check[order]
            cut = np.flatnonzero(np.concatenate(([True], lane[1:] != lane[:-1])))
            rows = [(int(lane[lo]), *_pack(ids[lo:hi], key[lo:hi], 6), check[lo:hi].tobytes())
                    for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(lane)).tolist())]
            return pa.RecordBatch.from_arrays(
                [pa.array(x, t) for x, t in zip(zip(*rows), (
                    pa.int32(), pa.binary(), pa.binary(), pa.binary()))],
                names=["lane", "ids", "keys", "checks"])

        size = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                own, texts, late, first = (batch.column(c).slice(i, 256) for c in (
                    "own", "t", "late", "first"))
                for doc, text, a, b in zip(own.to_pylist(), texts.to_pylist(), late, first):
                    told = np.concatenate((_longs(a), _longs(b))).view(np.uint64)
                    if not len(told):
                        continue
                    words = split_words(text)
                    tags = _tags(*_window_keys(words, cache, width, buckets))
                    starts = np.flatnonzero(np.isin(tags, told))
                    checks = np.fromiter(map(xxhash.xxh3_64_intdigest, _windows(words, starts, width)),
                                         np.uint64, len(starts))
                    tags, checks = _distinct(tags[starts], checks)
                    held.append((np.full(len(tags), doc, np.int64), *_keys(tags, lanes), checks))
                    size += len(tags)
                    if size >= SLICE:
                        yield flush()
                        size = 0
        if size:
            yield flush()
    return claim


def _clashes(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    """The documents of every window of one lane whose checks differ."""
    parts = [_unpack(i, k, 6) for i, k in zip(group["ids"], group["keys"])]
    ids, keys = (np.concatenate(x) for x in zip(*parts))
    checks = np.frombuffer(b"".join(group["checks"]), np.uint64)
    order = np.lexsort((checks, keys))
    k, c = keys[order], checks[order]
    bad = k[1:][(k[1:] == k[:-1]) & (c[1:] != c[:-1])]
    hit = np.isin(keys, bad)
    ids, keys = _distinct(ids[hit], keys[hit])
    names = _names(np.full(len(keys), key[0], np.int32), keys)
    return pd.DataFrame({"id": ids, "key": names.view(np.int64)})


def _clashing(tags: np.ndarray, keys: np.ndarray, lanes: int) -> np.ndarray:
    return np.isin(_names(*_keys(tags, lanes)), keys.view(np.uint64))


def _speller(width: int, buckets: int, lanes: int):
    """The words of all windows whose checks differ."""
    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for doc, text, keys in zip(batch.column("own").to_pylist(),
                                       batch.column("t"), batch.column("clashes")):
                words = split_words(text.as_py())
                tags = _tags(*_window_keys(words, cache, width, buckets))
                starts = np.flatnonzero(_clashing(tags, _longs(keys), lanes))
                for lo in range(0, len(starts), 10_000):
                    found = [bytes(w) for w in _windows(words, starts[lo:lo + 10_000], width)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([doc] * len(found), pa.int64()), pa.array(found, pa.binary())],
                        names=["id", "words"])
    return spell


def _clean_words(text: bytes | None, late: np.ndarray, clashes: np.ndarray, spelled: set[bytes],
                 cache: WordHashes, width: int, buckets: int,
                 lanes: int) -> tuple[list[bytes], int]:
    """(kept words, number of words): dropped are late windows without a clash, and
    those with one whose words are among ``spelled``."""
    words = split_words(text)
    if not len(late) and not spelled:
        return words, len(words)
    tags = _tags(*_window_keys(words, cache, width, buckets))
    drop = np.isin(tags, late.view(np.uint64))
    if len(clashes):
        unsure = _clashing(tags, clashes, lanes)
        at = np.flatnonzero(unsure)
        drop &= ~unsure
        drop[at] = [bytes(w) in spelled for w in _windows(words, at, width)]
    starts = np.flatnonzero(drop)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + width, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return [w for w, g in zip(words, gone.tolist()) if not g], len(words)


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     width: int = WIDTH) -> DataFrame:
    """(``doc_id``, ``n_words``, ``n_removed``, ``kept``) of every row: words of
    the text, words covered by a repeated window, the words left joined by one
    space. A text of fewer than ``width`` words loses none. Rows with one id
    (repeats) never drop each other's windows; a NULL id ranks after all others.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    amount = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("binary")))).first()[0] or 0
    buckets = max(parts, amount // BUCKET_BYTES)
    lanes = max(parts, buckets // 4)   # told windows are fewer
    told = (told_windows(docs, id_col, text_col, width, buckets)
            .groupBy("id").agg(F.collect_list(F.when(F.col("late"), F.col("tag"))).alias("late"),
                               F.collect_list(F.when(~F.col("late"), F.col("tag"))).alias("first")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("own"),
                       F.col(text_col).cast("binary").alias("t"))
    met = rows.join(told, rows["own"] == told["id"], "left").drop("id")
    clashes = (met.mapInArrow(_claimer(width, buckets, lanes), _CLAIM)
               .groupBy("lane").applyInPandas(_clashes, _CLASH)
               .groupBy("id").agg(F.collect_list("key").alias("clashes")))
    unsure = (met.join(clashes, met["own"] == clashes["id"]).drop("id")
              .mapInArrow(_speller(width, buckets, lanes), "id long, words binary").distinct())
    least = unsure.groupBy("words").agg(F.min("id").alias("least"))
    spelled = (unsure.join(least, "words").where(F.col("id") > F.col("least"))
               .groupBy("id").agg(F.collect_list("words").alias("spelled")))
    clashes = clashes.select(F.col("id").alias("clash_id"), "clashes")
    spelled = spelled.select(F.col("id").alias("spelled_id"), "spelled")
    met = (met.join(clashes, F.col("own") == F.col("clash_id"), "left")
           .join(spelled, F.col("own") == F.col("spelled_id"), "left")
           .drop("clash_id", "spelled_id"))

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                done = [_clean_words(t, _longs(a), _longs(c), set(s or ()), cache, width, buckets, lanes)
                        for t, a, c, s in zip(part.column("t").to_pylist(), part.column("late"),
                                              part.column("clashes"), part.column("spelled").to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([n for _, n in done], pa.int64()),
                     pa.array([n - len(k) for k, n in done], pa.int64()),
                     pa.array([b" ".join(k) for k, _ in done], pa.binary())],
                    names=["doc_id", "n_words", "n_removed", "kept"])

    return met.mapInArrow(clean, "doc_id long, n_words long, n_removed long, kept binary")
