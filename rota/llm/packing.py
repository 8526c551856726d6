"""Packing token sequences into bins of fixed capacity.

Documents become token ids (with an end id), longer ones are cut into pieces of
full capacity with the remainder first. Pieces over one third of the capacity
stand at most twice in a bin: they are matched greedily, the largest with the
largest that still fits. Smaller pieces go, largest first, where the gap that
remains is smallest.

Only how many pieces have each length matters for that, so the plan is made
from a histogram of at most ``capacity`` counts: runs of equal pieces are placed
at once, whatever their number. Pieces then find their run by their exact
place in the order of length, computed in parallel.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rota.llm.frames import positions
from rota.session import cut_lineage

CAPACITY = 2048
END_ID = 0
LONG_TEXT = 1 << 20

# Texts of these characters only, without a special token's opening, have the
# same ids from the rank file of the vocabulary as from its tokenizer file.
_PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7E¡-ſ‐-‧]*")
_SEAM = re.compile("(?<=[A-Za-z])(?= [A-Za-z])")


class Encoder:
    """Token ids of whole texts under one vocabulary.

    ``path`` is the tokenizer file; ``ranks`` the same vocabulary as a rank file
    with ``pattern``, a faster reader that is used where both provably agree.
    Long texts are encoded in parts cut between two words, where a token always
    ends.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        self.path, self.fast, self._slow = path, None, None
        if ranks:
            import base64

            import tiktoken
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table,
                                          special_tokens={})

    @property
    def slow(self):
        if self._slow is None:
            from tokenizers import Tokenizer
            self._slow = Tokenizer.from_file(self.path)
        return self._slow

    def part(self, text: str) -> np.ndarray:
        if self.fast is not None and "<|" not in text and _PLAIN.fullmatch(text):
            return np.array(self.fast.encode_ordinary(text), np.uint32)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while len(text) - at > LONG_TEXT:
            seam = _SEAM.search(text, at + LONG_TEXT // 2)
            if seam is None:
                break
            parts.append(self.part(text[at:seam.start()]))
            at = seam.start()
        parts.append(self.part(text[at:]))
        return np.concatenate(parts)


def token_pieces(docs: DataFrame, vocabulary: dict[str, str], capacity: int = CAPACITY,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every row of ``docs``. A NULL or
    empty text is the end id alone."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(**vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows: list[tuple] = []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.append(encoder.encode(text or ""), np.uint32(END_ID)).astype("<u4")
                    head = len(ids) % capacity or capacity
                    edges = [0, *range(head, len(ids) + 1, capacity)]
                    for n, (a, b) in enumerate(zip(edges, edges[1:])):
                        rows.append((doc, n, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("d"), F.col(text_col).alias("t")).mapInArrow(
        cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, number, first bin, offset): of the pieces of that
    length, those from the first rank on go one to a bin, at that offset.

    ``counts`` is pieces by length, 1 to ``capacity``. Bins that are filled alike are
    handled as ranges of numbers.
    """
    left, rank, runs = dict(counts), dict.fromkeys(counts, 0), []
    gaps: dict[int, list[tuple[int, int]]] = {}      # gap -> ranges (first bin, number)
    open_gaps: list[int] = []
    bins = 0

    def place(size: int, number: int, first: int, offset: int) -> None:
        runs.append((size, rank[size], number, first, offset))
        rank[size] += number
        left[size] -= number

    def leave(gap: int, first: int, number: int) -> None:
        if gap and number:
            if gap not in gaps:
                gaps[gap] = []
                insort(open_gaps, gap)
            gaps[gap].append((first, number))

    large = sorted((s for s in counts if 3 * s > capacity), reverse=True)
    for size in large:
        while left[size]:
            mate = next((s for s in large if s <= min(size, capacity - size) and left[s]
                         and (s != size or left[s] > 1)), None)
            if mate is None:
                number = left[size]
            elif mate == size:
                number = left[size] // 2
            else:
                number = min(left[size], left[mate])
            place(size, number, bins, 0)
            if mate is not None:
                place(mate, number, bins, size)
            leave(capacity - size - (mate or 0), bins, number)
            bins += number

    for size in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while left[size]:
            at = bisect_left(open_gaps, size)
            if at == len(open_gaps):
                fresh = -(-left[size] // (capacity // size))
                leave(capacity, bins, fresh)
                bins += fresh
                continue
            gap = open_gaps[at]
            first, number = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], open_gaps[at]
            used = min(number, left[size])
            place(size, used, first, capacity - gap)
            leave(gap, first + used, number - used)
            leave(gap - size, first, used)
    return runs


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (from ``token_pieces``) with ``sequence_id`` and ``offset``. Pieces
    of one length are exchangeable; which goes where follows their order by id,
    checksum and number. An empty table gives no rows."""
    pieces = cut_lineage(pieces)
    counts = {r["length"]: r["n"] for r in
              pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = {}, 0
    for length in sorted(counts):
        before[length] = total
        total += counts[length]
    runs = sorted((before[s] + r, first, offset) for s, r, _, first, offset in plan_bins(counts, capacity))
    table = pieces.sparkSession.sparkContext.broadcast(
        np.array(runs, np.int64).reshape(-1, 3))   # a few per length, at any scale
    placed = positions(pieces, ["length", "doc_id", "ids_crc32", "piece"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, first, offset = table.value.T
        for batch in batches:
            at = batch.column(5).to_numpy()
            run = np.searchsorted(start, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in range(5)]
                + [pa.array(first[run] + at - start[run], pa.int64()), pa.array(offset[run], pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "_pos").mapInArrow(
        settle, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                "sequence_id long, offset long")
