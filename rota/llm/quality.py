"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text becomes a vector of hashed terms - words, three-character patterns of
character classes, and binned shape measures - weighted by log counts and
inverse document frequency. A bounded sample of labelled texts gives the term
weights and, by singular value decomposition, a latent space of ``DIMS``
dimensions. The sample's latent vectors and labels are broadcast (their size is
``SAMPLE`` x ``DIMS`` numbers at any scale); every document, block by block, is
compared with all of them by exact cosine products, and its ``NEIGHBOURS`` most
similar vote with their similarity as weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rota.llm.words import WordHashes

SAMPLE = 4096        # labelled texts that the model is fitted on, at most
DIMS = 48
NEIGHBOURS = 9
THRESHOLD = 0.3
BLOCK = 256          # documents compared at a time

_WORD_TERMS, _SHAPE_TERMS, _BINS, _MEASURES = 1024, 1024, 12, 6
TERMS = _WORD_TERMS + _SHAPE_TERMS + _BINS * _MEASURES
_MEASURE_WEIGHT = 4.0
_PLACES = 5

# Character classes: lower-case and non-ASCII letters, upper case, digits,
# space, newline, other control; each punctuation mark its own (32 in all, folded).
_CLASS = np.ones(256, np.int64)
_CLASS[0:32], _CLASS[10], _CLASS[32] = 5, 4, 3
_CLASS[48:58], _CLASS[65:91], _CLASS[97:123] = 2, 0, 1
for _n, _b in enumerate([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 128)]):
    _CLASS[_b] = 6 + _n % 26


def _bin(value: float, low: float, high: float) -> int:
    return int(min(max((value - low) / (high - low), 0.0), 0.999) * _BINS)


def term_counts(text: bytes, cache: WordHashes) -> np.ndarray:
    """Log-damped counts of the terms of one whole text."""
    out = np.zeros(TERMS, np.float32)
    if not text:
        return out
    raw = _CLASS[np.frombuffer(text, np.uint8)]
    if len(raw) > 2:
        tri = (raw[:-2] * 1024 + raw[1:-1] * 32 + raw[2:]) * 2654435761 >> 7 & _SHAPE_TERMS - 1
        out[_WORD_TERMS:_WORD_TERMS + _SHAPE_TERMS] = np.bincount(tri, minlength=_SHAPE_TERMS)
    words = text.lower().split()
    lines = text.split(b"\n")
    if words:
        hashes = cache.of(words)
        out[:_WORD_TERMS] = np.bincount((hashes >> np.uint64(20)).astype(np.int64) & _WORD_TERMS - 1,
                                        minlength=_WORD_TERMS)
    np.log1p(out, out=out)
    n = max(len(words), 1)
    classes = np.bincount(raw, minlength=32) / len(raw)
    doubled = float(np.mean(hashes[1:] == hashes[:-1])) if len(words) > 1 else 0.0
    measures = (
        _bin(len(set(words)) / n / (n ** -0.15), 0, 1),    # distinct words, for the length
        _bin(doubled, 0, 0.5),                              # words equal to the one before
        _bin(len(set(lines)) / len(lines), 0, 1),           # distinct lines
        _bin(float(classes[6:].sum()), 0, 0.3),             # punctuation and symbols
        _bin(float(classes[0]), 0, 0.5),                    # upper case
        _bin(len(text) / n, 2, 14),                         # length of a word with its space
    )
    for m, b in enumerate(measures):
        out[_WORD_TERMS + _SHAPE_TERMS + m * _BINS + b] = _MEASURE_WEIGHT
    return out


@dataclass
class Model:
    """Term weights, latent axes, the sample's latent vectors and their labels."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def latent(self, counts: np.ndarray) -> np.ndarray:
        x = counts * self.weights
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
        z = x @ self.axes
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Share of label 1 in the similarity-weighted votes; the sample's share
        of label 1 where no neighbour has a positive similarity. Of neighbours
        equally similar (to ``_PLACES`` decimals) those first in the sample vote,
        whose order is a hash of the id."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosine = np.round(self.latent(counts) @ self.vectors.T, _PLACES)
        k = min(NEIGHBOURS, cosine.shape[1])
        kth = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k][:, None]
        tied = cosine == kth
        room = k - (cosine > kth).sum(1, keepdims=True)
        near = (cosine > kth) | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= room))
        weight = np.where(near, np.maximum(cosine, 0), 0).astype(np.float64)
        total, votes = weight.sum(1), weight @ self.labels
        return np.where(total > 1e-9, votes / np.maximum(total, 1e-9), self.labels.mean())


def learn(counts: np.ndarray, labels: np.ndarray, dims: int = DIMS) -> Model:
    """Fit on the term counts (rows) and labels of the sample."""
    seen = (counts > 0).sum(0)
    weights = np.log((1 + len(counts)) / (1 + seen)).astype(np.float32) + 0.2
    model = Model(weights, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels)
    if len(counts):
        # Right singular vectors, from the Gram matrix of the terms; in blocks, so that
        # the counts are held once.
        blocks = [slice(i, i + BLOCK) for i in range(0, len(counts), BLOCK)]
        gram = np.zeros((counts.shape[1], counts.shape[1]), np.float32)
        for b in blocks:
            x = counts[b] * weights
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
            gram += x.T @ x
        values, vectors = np.linalg.eigh(gram)
        # A small sample spans fewer dimensions; what is left of the axes is arbitrary.
        real = int((values[-dims:] > 1e-5 * values[-1]).sum())
        model.axes = np.ascontiguousarray(vectors[:, ::-1][:, :max(real, 1)].astype(np.float32))
        del gram, vectors
        model.vectors = np.concatenate([model.latent(counts[b]) for b in blocks])
    return model


def held_out(id_col: str) -> Column:
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled texts: those first by a hash of
    their id among the labelled ids of ``labels`` that are not held out and have
    a label and a text in ``docs``. Repeated labels of an id count once (the
    smallest), repeated texts of an id are each learned from. Term counts are
    made in Spark and meet in one task, which learns from them (``sample`` rows of
    ``2 TERMS`` bytes at any scale); the driver gets the model alone."""
    known = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
                          & ~held_out(id_col))
             .groupBy(F.col(id_col).alias("_lid")).agg(F.min(label_col).cast("int").alias("_y")))
    there = docs.select(F.col(id_col).alias("_there")).distinct()
    known = known.join(there, known["_lid"] == there["_there"], "left_semi")
    chosen = known.orderBy(F.xxhash64("_lid"), "_lid").limit(sample)   # so broadcast
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("_t"))
    rows = (texts.join(F.broadcast(chosen), F.col("_id") == F.col("_lid")).select("_id", "_t", "_y")
            .where(F.col("_t").isNotNull()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK):
                part = batch.slice(i, BLOCK)
                packed = [term_counts(t, cache).astype(np.float16).tobytes()
                          for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).cast(pa.int64()), part.column(2), pa.array(packed, pa.binary())],
                    names=["id", "y", "x"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        found.sort(key=lambda r: (r[0], r[1], r[3]))
        x, y = np.empty((len(found), TERMS), np.float32), np.array([r[2] for r in found], np.float64)
        for i in range(len(found)):
            x[i], found[i] = np.frombuffer(found[i][3], np.float16), None
        m = learn(x, y)
        yield pa.RecordBatch.from_arrays(
            [pa.array([v.tobytes()], pa.binary()) for v in (m.weights, m.axes, m.vectors, m.labels)],
            names=["weights", "axes", "vectors", "labels"])

    order = F.xxhash64("id")
    found = (rows.mapInArrow(count, "id long, y int, x binary").orderBy(order, "id", "x").limit(sample)
             .select(order.alias("h"), "id", "y", "x").coalesce(1)
             .mapInArrow(fitted, "weights binary, axes binary, vectors binary, labels binary").collect())
    if not found:
        return learn(np.empty((0, TERMS), np.float32), np.empty(0))
    m, of = found[0], lambda packed, kind: np.frombuffer(packed, kind).copy()
    axes, labels = of(m["axes"], np.float32).reshape(TERMS, -1), of(m["labels"], np.float64)
    return Model(of(m["weights"], np.float32), axes,
                 of(m["vectors"], np.float32).reshape(len(labels), axes.shape[1]), labels)


def score_column(spark, model: Model, text_col: str = "text") -> Column:
    """Score of a whole text, 0 to 1; higher: label 1 is likelier."""
    shared = spark.sparkContext.broadcast((model.weights, model.axes, model.vectors, model.labels))

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cache, m = WordHashes(), Model(*shared.value)
        for batch in texts:
            out = np.zeros(len(batch))
            for i in range(0, len(batch), BLOCK):
                part = batch.iloc[i:i + BLOCK]
                counts = np.stack([term_counts(bytes(t) if t is not None else b"", cache)
                                   for t in part])
                out[i:i + BLOCK] = m.scores(counts)
            yield pd.Series(out)
    return score(F.col(text_col).cast("binary"))


def score_quality(docs: DataFrame, labels: DataFrame, out: str = "score", id_col: str = "doc_id",
                  text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` with ``out``, the score of every row. NULL and empty texts have no
    terms, so they get the sample's share of label 1; 0.5 where nothing is
    labelled. Repeated rows get equal scores."""
    model = fit(docs, labels, id_col, text_col, sample=sample)
    return docs.withColumn(out, score_column(docs.sparkSession, model, text_col))


def drop_low_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id",
                     text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns kept."""
    out = "_quality_score"
    while out in docs.columns:
        out += "_"
    scored = score_quality(docs, labels, out, id_col, text_col)
    return scored.where(F.col(out) >= threshold).drop(out)
