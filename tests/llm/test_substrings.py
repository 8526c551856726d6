import hashlib
import random

import numpy as np
import pytest

from rota.llm import queries, substrings
from rota.sources.tables import read_table
from tests.conftest import SF_SMALL
from tests.llm.corpus import SCHEMA, awkward_texts, frame, sample_docs


def brute(rows, width=13):
    none = 1 << 63
    split = [(none if i is None else i, (t or "").encode().split()) for i, t in rows]
    low = {}
    for i, w in split:
        for a in range(len(w) - width + 1):
            key = tuple(w[a:a + width])
            low[key] = min(i, low.get(key, i))
    out = []
    for (doc, _), (i, w) in zip(rows, split):
        gone = [False] * len(w)
        for a in range(len(w) - width + 1):
            if low[tuple(w[a:a + width])] < i:
                gone[a:a + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.n_words, r.n_removed, hashlib.sha256(r.kept).hexdigest())
                   for r in df.collect()), key=str)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF_SMALL, "documents").collect()]
    got = sorted((tuple(r) for r in queries.op3_substrings(spark, SF_SMALL).collect()), key=str)
    assert got == brute(rows)


def test_awkward_rows(spark):
    rows = sample_docs(spark)
    assert result(substrings.dedup_substrings(frame(spark, rows))) == brute(rows)


@pytest.mark.parametrize("limit", [50, 400])
def test_small_slices_and_tiny_vocabulary(spark, monkeypatch, limit):
    monkeypatch.setattr(substrings, "SLICE", limit)
    rng = random.Random(limit)
    rows = [(rng.randrange(60), " ".join(rng.choice("ab") for _ in range(rng.randrange(90))))
            for _ in range(150)] + awkward_texts()
    rows = [r for r in rows if r[1] is None or len(r[1]) < 50_000]
    assert result(substrings.dedup_substrings(frame(spark, rows), width=5)) == brute(rows, 5)


@pytest.mark.parametrize("bits", [0, 3, 9])
def test_forced_collisions(spark, monkeypatch, bits):
    """Hashes of so few bits that different windows share all of them."""
    whole = substrings.rolling
    monkeypatch.setattr(substrings, "rolling", lambda hashes, width, odd=1: (
        whole(hashes, width, odd) >> np.uint64(40) & np.uint64((1 << bits) - 1)) << np.uint64(24))
    monkeypatch.setattr(substrings, "SLICE", 700)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 1000)
    rows = [r for r in awkward_texts() if r[1] is None or len(r[1]) < 50_000]
    assert result(substrings.dedup_substrings(frame(spark, rows))) == brute(rows)


def test_empty_table(spark):
    out = substrings.dedup_substrings(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and out.columns == ["doc_id", "n_words", "n_removed", "kept"]
