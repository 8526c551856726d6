import random

import pytest
from pyspark.sql import functions as F

from rota.llm import hamming, queries
from rota.sources.tables import read_table
from tests.conftest import SF_SMALL

CODE = "id long, code array<long>, near string"


def brute(queries_, base, k):
    out = []
    for q, code in {(i, tuple(c)) for i, c in queries_}:
        near = sorted((sum((x ^ y).bit_count() if (x ^ y) >= 0 else ((x ^ y) & (1 << 64) - 1).bit_count()
                           for x, y in zip(code, c)), i is None, i or 0) for i, c in base)[:k]
        out += [(q, r + 1, None if none else i, d) for r, (d, none, i) in enumerate(near)]
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_matches_brute_force(spark):
    vectors = [(r.vec_id, [sum(1 << b for b, x in enumerate(r.embedding) if x > 0)])
               for r in read_table(spark, SF_SMALL, "embeddings").collect()]
    want = brute([v for v in vectors if v[0] % 100 == 0], vectors, 10)
    assert result(queries.op7_hamming_top_k(spark, SF_SMALL)) == want


@pytest.mark.parametrize("dims", [24, 64, 96])
def test_ties_copies_and_nulls(spark, dims):
    rng = random.Random(dims)

    def code(bits):
        return [(bits >> lo & (1 << 64) - 1 if dims - lo >= 64 else bits >> lo & (1 << dims - lo) - 1)
                for lo in range(0, dims, 64)]
    signed = lambda c: [x - (1 << 64) if x >> 63 else x for x in c]
    base, hot = [], rng.getrandbits(dims)
    for i in range(240):
        bits = hot if i % 3 == 0 else hot ^ (1 << rng.randrange(dims)) if i % 3 == 1 else rng.getrandbits(dims)
        base.append((None if i == 30 else i % 200, signed(code(bits))))
    asked = base[:6] + [base[2], (999, signed(code(hot ^ 7)))]
    out = hamming.top_k(spark.createDataFrame([(*a, "x") for a in asked], CODE),
                        spark.createDataFrame([(*b, "x") for b in base], CODE), 7, dims)
    assert result(out) == brute(asked, base, 7)


def test_few_rows_and_empty_tables(spark):
    base = spark.createDataFrame([(1, [5], ""), (2, [(1 << 24) - 1], "")], CODE)
    none = spark.createDataFrame([], CODE)
    assert result(hamming.top_k(base, base, 5, 16 + 8)) == result(
        spark.createDataFrame([(1, 1, 1, 0), (1, 2, 2, 22), (2, 1, 2, 0), (2, 2, 1, 22)], "q long, r int, i long, d int"))
    assert hamming.top_k(none, base, 3, 24).collect() == []
    assert hamming.top_k(base, none, 3, 24).collect() == []


def test_codes_of_odd_vectors(spark):
    rows = [([1.0, -1.0, 2.0],), (None,), ([],), ([None, 3.0],)]
    df = spark.createDataFrame(rows, "v array<double>")
    got = [r.c for r in df.select(hamming.sign_code(F.col("v"), 64).alias("c")).collect()]
    assert got == [[5], [0], [0], [2]]


@pytest.mark.parametrize("dims, codes, bits", [
    (64, 0, {8}), (64, 10_000, {12, 13}), (64, 51_000, {16}), (64, 10**12, {21, 22}),
    (96, 1 << 20, {21, 22, 16}), (24, 10**9, {24}), (5, 100, {5})])
def test_chunks_follow_the_number_of_codes(dims, codes, bits):
    chunks = hamming._chunks(dims, codes)
    assert {b for _, _, b in chunks} == bits
    cover = sorted(w * 64 + shift + i for w, shift, b in chunks for i in range(b))
    assert cover == list(range(dims))


def test_long_chunks(spark, monkeypatch):
    monkeypatch.setattr(hamming, "LEAST_BITS", 12)
    rng = random.Random(3)
    base = [(i, [rng.getrandbits(24)]) for i in range(150)]
    df = spark.createDataFrame([(*b, "x") for b in base], CODE)
    assert result(hamming.top_k(df.limit(9), df, 4, 24)) == brute(base[:9], base, 4)


def test_probes_of_a_query_stay_few(spark, monkeypatch):
    # Lists of one code took 6000 probes for each of these queries.
    base = spark.range(20_000).select("id", F.array(F.xxhash64("id")).alias("code"))
    asked = base.where("id % 2000 = 7").cache()
    rows, probes, meet = [(r.id, r.code) for r in base.collect()], [], hamming._meet

    def counted(made, entries):
        probes.append(made.count())
        return meet(made, entries)
    monkeypatch.setattr(hamming, "_meet", counted)
    out = hamming.top_k(asked, base, 3, 64)
    assert result(out) == brute([r for r in rows if r[0] % 2000 == 7], rows, 3)
    assert sum(probes) < 1500 * 10
