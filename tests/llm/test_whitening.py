import math

import numpy as np
import pytest
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from rota.llm import queries, whitening
from rota.llm.spectrum import Spectrum
from rota.sources.tables import read_table
from tests.conftest import SF_ORACLE

SCHEMA = StructType([StructField("vec_id", LongType()), StructField("embedding", ArrayType(DoubleType())),
                     StructField("component", StringType()), StructField("m", StringType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], "clash", "clash")
                                  for i, v in rows],
                                 SCHEMA).repartition(3)


def good(v, dims):
    return v is not None and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, dims, components=16):
    """Everything from the exact integer covariance matrix."""
    kept = [(i, tuple(math.floor(64 * c) + 1_000_000 for c in v)) for i, v in rows if good(v, dims)]
    fit = sorted({x for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    away = np.array([[n * a - s for a, s in zip(x, sums)] for x in fit], dtype=object)
    cov = (away.T @ away).astype(float) / float(n) ** 3
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = sum(v > 1e-11 * values[0] for v in values[:components])
    out = []
    for i, x in kept:
        c = [n * a - s for a, s in zip(x, sums)]
        white = (np.array(c, dtype=float) / n) @ (vectors[:, :k] / np.sqrt(values[:k]))
        out.append((i, n, sum(a * a for a in c), white, values[:k] / np.trace(cov)))
    return out


def same(found, want):
    """Rows of the result against ``brute``, up to one sign a component."""
    by_row = {}
    for r in found:
        assert r.identity_error <= 1e-4 and r.identity_error == found[0].identity_error
        by_row.setdefault(r.vec_id, []).append(r)
    k = len(want[0][4])
    got, wanted = [], []
    for i in {w[0] for w in want}:
        mine = sorted(by_row.pop(i), key=lambda r: (r.component, r.whitened))
        them = [w for w in want if w[0] == i]
        assert {(r.n, r.deviation) for r in mine} == {(w[1], w[2]) for w in them}
        assert [r.component for r in mine] == sorted(list(range(1, k + 1)) * len(them))
        assert np.allclose([r.explained for r in mine[::len(them)]], them[0][4], rtol=1e-9)
        if len({w[2] for w in them}) == 1:
            got.append([r.whitened for r in mine[::len(them)]])
            wanted.append(them[0][3])
    assert not by_row
    got, wanted = np.array(got), np.array(wanted)
    signs = np.sign((got * wanted).sum(0))
    assert np.allclose(got, wanted * signs, atol=1e-7)


def test_query_matches_the_exact_covariance(spark):
    rows = [(r.vec_id, r.embedding) for r in read_table(spark, SF_ORACLE, "embeddings").collect()]
    same(queries.op13_whitening(spark, SF_ORACLE).collect(), brute(rows, 64))


def awkward_rows(rng, dims=5, count=300):
    rows = [(i, list(rng.normal(size=dims) * (1, 3, 0.2, 5, 1)[:dims])) for i in range(count)]
    rows += [(1000 + i, rows[7][1]) for i in range(200)]          # copies of one vector
    rows += [rows[3], rows[3], (rows[4][0], rows[5][1]), (None, rows[6][1])]
    bad = [None, [], [None] * dims, [1.0, None, 1.0, 1.0, 1.0], [math.nan] + [0.0] * (dims - 1),
           [0.0] * (dims - 1) + [math.inf], [-math.inf] + [0.0] * (dims - 1), [1.0] * (dims + 1), [1.0]]
    return rows + [(2000 + i, v) for i, v in enumerate(bad)]


def test_awkward_rows(spark):
    rows = awkward_rows(np.random.default_rng(3))
    same(whitening.whiten(frame(spark, rows)).collect(), brute(rows, 5))


def test_many_partitions_and_a_deep_tree(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FIT_ROWS", 8)
    monkeypatch.setattr(whitening, "FAN_IN", 3)
    rows = awkward_rows(np.random.default_rng(4))
    same(whitening.whiten(frame(spark, rows)).collect(), brute(rows, 5))


def test_missing_rank_and_fewer_components(spark):
    rng = np.random.default_rng(5)
    flat = [(i, [a, 2 * math.floor(64 * a) / 64, 1.5, b]) for i, (a, b) in enumerate(
        np.floor(rng.normal(size=(100, 2)) * 64) / 64)]
    found = whitening.whiten(frame(spark, flat)).collect()
    assert max(r.component for r in found) == 2 and len(found) == 200
    same(found, brute(flat, 4))
    assert {r.component for r in whitening.whiten(frame(spark, flat), components=1).collect()} == {1}


def test_large_numbers_stay_exact(spark):
    rng = np.random.default_rng(6)
    rows = [(i, list(v)) for i, v in enumerate(rng.normal(size=(40, 3)) * (1e3, 2.0**44, 2.0**20))]
    rows.append((99, [2.0**60, 0.0, 0.0]))
    want = {w[0]: w[2] for w in brute(rows[:-1], 3)}
    found = whitening.whiten(frame(spark, rows)).collect()
    assert {r.vec_id for r in found} == set(want)
    for r in found:
        assert r.deviation == (want[r.vec_id] if want[r.vec_id] < 2**63 else None)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [math.nan])], [(1, [1.0, 2.0])],
                                  [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_fit(spark, rows):
    found = whitening.whiten(frame(spark, rows))
    assert found.collect() == [] and found.columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


@pytest.mark.parametrize("kind", ["spread", "integers", "flat", "few", "huge gap"])
def test_spectrum_follows_its_points(kind):
    rng = np.random.default_rng(7)
    points = {"spread": rng.normal(size=(200, 12)) * np.exp(rng.normal(size=12)),
              "integers": rng.integers(0, 2, size=(150, 6)).astype(float),
              "flat": np.hstack([rng.normal(size=(60, 3)), np.zeros((60, 4))]),
              "few": rng.normal(size=(3, 9)),
              "huge gap": rng.normal(size=(80, 5)) * (1e6, 1e3, 1.0, 1e-3, 1e-6)}[kind]
    one, halves = Spectrum(points.shape[1]), [Spectrum(points.shape[1]) for _ in range(3)]
    for i, x in enumerate(points):
        one.add(x)
        halves[i % 2].add(x)
    both = Spectrum.from_bytes(halves[0].to_bytes(), points.shape[1])
    both.merge(halves[2])      # nothing in it
    both.merge(halves[1])
    away = points - points.mean(0)
    exact = away.T @ away
    for s in (one, both):
        assert s.n == len(points) and np.allclose(s.mean, points.mean(0))
        assert np.abs(s.scatter() - exact).max() <= 1e-12 * np.abs(exact).max()
        assert np.abs(s.vectors.T @ s.vectors - np.eye(len(exact))).max() <= 1e-12
        assert (np.diff(s.values) >= -1e-12 * np.abs(exact).max()).all()
