import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from rota.llm import packing, queries
from rota.sources.tables import read_table
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.llm.corpus import SCHEMA, awkward_texts, frame

TOKENIZER = Tokenizer.from_file(queries.VOCABULARY["path"])


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [0]


def check(docs, out, capacity=2048):
    want = []
    for doc, text in docs:
        ids = ids_of(text)
        head = len(ids) % capacity or capacity
        edges = [0, *range(head, len(ids) + 1, capacity)]
        for n, (a, b) in enumerate(zip(edges, edges[1:])):
            want.append((doc, n, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def first_fit_decreasing(sizes, capacity):
    gaps = []
    for s in sorted(sizes, reverse=True):
        for i, g in enumerate(gaps):
            if g >= s:
                gaps[i] -= s
                break
        else:
            gaps.append(capacity - s)
    return len(gaps)


def test_query_round_trip(spark):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF_SMALL, "documents").collect()]
    out = queries.op9_packing(spark, SF_SMALL).collect()
    bins = check(docs, out)
    assert bins <= first_fit_decreasing([r.length for r in out], 2048) + 1


@pytest.mark.parametrize("capacity", [2048, 64])
def test_awkward_rows(spark, capacity):
    texts = awkward_texts() + [(70_000, "a <|endoftext|> b"), (70_001, "日本語 テキスト\u0085 \x1c x"),
                               (70_002, "x" * 5000), (70_003, " \n " * 900)]
    out = packing.pack(packing.token_pieces(frame(spark, texts), queries.VOCABULARY, capacity), capacity)
    check(texts, out.collect(), capacity)


def test_empty_table(spark):
    out = packing.pack(packing.token_pieces(spark.createDataFrame([], SCHEMA), queries.VOCABULARY))
    assert out.collect() == []


@pytest.mark.parametrize("seed", range(20))
def test_plan_places_every_piece_and_wastes_little(seed):
    rng = random.Random(seed)
    capacity = rng.choice([30, 100, 2048])
    sizes = [min(capacity, max(1, int(rng.paretovariate(0.8)))) if seed % 2 else rng.randint(1, capacity)
             for _ in range(rng.randint(1, 800))]
    counts = defaultdict(int)
    for s in sizes:
        counts[s] += 1
    fill, ranks = defaultdict(list), defaultdict(list)
    for size, rank, number, first, offset in packing.plan_bins(dict(counts), capacity):
        ranks[size] += range(rank, rank + number)
        for b in range(first, first + number):
            fill[b].append((offset, size))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in counts.items()}
    for pieces in fill.values():
        at = 0
        for offset, size in sorted(pieces):
            assert offset == at
            at += size
        assert at <= capacity and sum(3 * s > capacity for _, s in pieces) <= 2
    assert len(fill) <= first_fit_decreasing(sizes, capacity) * 1.05 + 1


def test_plan_size_does_not_grow_with_the_rows():
    rng = random.Random(1)
    counts = {s: rng.randint(1, 9) for s in range(1, 2049)}
    small = len(packing.plan_bins(counts))
    large = len(packing.plan_bins({s: n * 10**9 for s, n in counts.items()}))
    assert large < 60_000 and small < 60_000


def test_rank_file_and_tokenizer_agree():
    encoder = packing.Encoder(**queries.VOCABULARY)
    rng = random.Random(2)
    plain = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x180), *range(0x2010, 0x2028)]]
    for _ in range(600):
        text = "".join(rng.choice(plain if rng.random() < 0.5 else " \n\taeiou'st0") for _ in range(80))
        assert packing._PLAIN.fullmatch(text)
        assert encoder.encode(text).tolist() == ids_of(text)[:-1], repr(text)


def test_rank_file_and_tokenizer_agree_on_the_given_documents(spark):
    encoder = packing.Encoder(**queries.VOCABULARY)
    texts = [r.text or "" for r in read_table(spark, SF_ORACLE, "documents").select("text").collect()]
    assert len(texts) == 1000
    assert all(encoder.encode(t).tolist() == ids_of(t)[:-1] for t in texts)


def test_long_text_is_cut_where_a_token_ends(monkeypatch):
    monkeypatch.setattr(packing, "LONG_TEXT", 50)
    encoder, rng = packing.Encoder(**queries.VOCABULARY), random.Random(3)
    for _ in range(50):
        text = "".join(rng.choice(["word ", "it's ", "  ", "\n", "42", "!", "a b", "ñ "]) for _ in range(150))
        assert encoder.encode(text).tolist() == ids_of(text)[:-1]
