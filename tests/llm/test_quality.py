import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rota.llm import quality, queries
from rota.llm.words import WordHashes
from rota.sources.tables import read_table
from tests.conftest import SF_ORACLE
from tests.llm.corpus import SCHEMA, awkward_texts, frame, sentence

LABELS = "doc_id long, quality int, text string"


def brute_bounds(texts, sample, labels):
    """Least and greatest score of every text, whichever of nearly equal neighbours
    vote: weights, latent space and votes in double precision from the definition."""
    cache = WordHashes()
    terms = lambda ts: np.stack([quality.term_counts((t or "").encode(), cache) for t in ts]).astype(float)
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    x, labels = terms(sample), np.array(labels, float)
    weights = np.log((1 + len(x)) / (1 + (x > 0).sum(0))) + 0.2
    _, sizes, axes = np.linalg.svd(unit(x * weights), full_matrices=False)
    axes = axes[:quality.DIMS][sizes[:quality.DIMS] ** 2 > 1e-5 * sizes[0] ** 2]
    near = unit(unit(x * weights) @ axes.T)
    out = []
    for v in unit(unit(terms(texts) * weights) @ axes.T):
        sims = near @ v
        kth = np.sort(sims)[-min(quality.NEIGHBOURS, len(sims))]
        sure, even = sims > kth + 1e-4, abs(sims - kth) <= 1e-4
        room, ones = min(quality.NEIGHBOURS, len(sims)) - sure.sum(), int(labels[even].sum())
        kept = np.maximum(sims[sure], 0)
        total = kept.sum() + max(kth, 0) * room
        votes = [(kept @ labels[sure] + max(kth, 0) * n) / total if total > 1e-6 else labels.mean()
                 for n in (max(0, room - (even.sum() - ones)), min(room, ones))]
        out.append((min(votes) - 1e-3, max(votes) + 1e-3))
    return out


def test_query_scores_held_out_rows_well(spark):
    rows = queries.op8_quality(spark, SF_ORACLE).collect()
    truth = {r.doc_id: r.quality for r in read_table(spark, SF_ORACLE, "labels").collect()}
    assert len(rows) == read_table(spark, SF_ORACLE, "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    held = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(a > b) + (a == b) / 2 for a in ones for b in zeros])
    assert auc > 0.95 and np.mean([(s >= 0.3) == y for s, y in held]) > 0.93


def test_scores_match_brute_force(spark):
    rng = random.Random(8)
    texts = [sentence(rng, rng.randint(5, 60)) + rng.choice([".", "!!", " 12 34", "\nA B\nA B", ""])
             for _ in range(260)]
    texts += texts[:20] + ["", None]
    labels = [(i, int("!" in t) ^ (rng.random() < 0.2), "clash") for i, t in enumerate(texts[:200])]
    known = [i for i, _, _ in labels if zlib.crc32(str(i).encode()) % 5]
    out = quality.score_quality(frame(spark, list(enumerate(texts))), spark.createDataFrame(labels, LABELS))
    got = {r.doc_id: r.score for r in out.collect()}
    bounds = brute_bounds(texts, [texts[i] for i in known], [labels[i][1] for i in known])
    assert all(low <= got[i] <= high for i, (low, high) in enumerate(bounds))
    assert np.mean([high - low < 0.01 for low, high in bounds]) > 0.7


def test_equal_neighbours_vote_in_the_order_of_the_sample():
    counts = np.stack([quality.term_counts(b"one two three", WordHashes())] * 30)
    labels = np.array([1.0] * 4 + [0.0] * 26)
    model = quality.learn(counts, labels)
    for block in (counts[:1], counts[:7], counts):
        assert model.scores(block) == pytest.approx(np.full(len(block), 4 / 9))


def test_awkward_rows(spark):
    texts = awkward_texts()
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(i * 3, i % 2, "x") for i in range(60)]
                                   + [(0, None, "x"), (None, 1, "x"), (3, 0, "x"), (999_999, 1, "x")], LABELS)
    out = quality.score_quality(docs, labels)
    rows = out.collect()
    assert out.columns == [*docs.columns, "score"] and len(rows) == len(texts)
    by_text = {}
    for r in rows:
        by_text.setdefault(r.text or "", set()).add(round(r.score, 6))
    assert all(len(s) == 1 for s in by_text.values()) and all(0 <= r.score <= 1 for r in rows)


@pytest.mark.parametrize("labels,score", [([], 0.5), ([(1, 1, "x")], 1.0), ([(1, 0, "x")], 0.0)])
def test_few_labels(spark, labels, score):
    docs = frame(spark, [(1, "a b c"), (2, None), (3, "")])
    out = quality.score_quality(docs, spark.createDataFrame(labels, LABELS)).collect()
    assert [r.score for r in out] == [score] * 3


def test_sample_bound_and_empty_table(spark):
    docs = frame(spark, [f"text number {i}" for i in range(200)])
    labels = spark.createDataFrame([(i, 1, "x") for i in range(200)], LABELS)
    assert len(quality.fit(docs, labels, sample=40).labels) == 40
    assert quality.score_quality(spark.createDataFrame([], SCHEMA), labels).collect() == []


def test_low_quality_rows_go(spark):
    docs = frame(spark, ["a b", "c d"])
    kept = quality.drop_low_quality(docs, spark.createDataFrame([(1, 0, "x")], LABELS))
    assert kept.columns == docs.columns and kept.count() == 0


def test_the_driver_gets_the_model_alone(spark, monkeypatch):
    rng = random.Random(18)
    texts = [sentence(rng, rng.randint(3, 30)) + rng.choice([".", "!"]) for _ in range(90)]
    labels = [(i, i % 2, "x") for i in range(90)]
    known = sorted(i for i in range(90) if zlib.crc32(str(i).encode()) % 5)
    hashed = spark.createDataFrame([(i,) for i in known], "id long").orderBy(F.xxhash64("id"))
    order, cache = [r.id for r in hashed.collect()], WordHashes()
    counts = np.stack([quality.term_counts(texts[i].encode(), cache).astype(np.float16) for i in order])
    want = quality.learn(counts.astype(np.float32), np.array([i % 2 for i in order], float))

    def here(*args):
        raise AssertionError("learned in the driver")
    frames = frame(spark, list(enumerate(texts))), spark.createDataFrame(labels, LABELS)
    monkeypatch.setattr(quality.np.linalg, "eigh", here)   # the driver's alone
    got = quality.fit(*frames)
    assert (got.labels == want.labels).all() and np.allclose(got.weights, want.weights)
    asked = counts[:20].astype(np.float32)
    assert got.vectors.shape == want.vectors.shape and got.scores(asked) == pytest.approx(want.scores(asked), abs=1e-3)
