import random
import re
from itertools import combinations

import numpy as np
import pytest
import xxhash

from rota.llm import graph, queries, simhash
from tests.conftest import SF_SMALL
from tests.llm.corpus import SCHEMA, awkward_texts, frame, sentence
from rota.sources.tables import read_table


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in combinations(distinct, 2):
        if (a ^ b).bit_count() <= 4:
            root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for (i, _), f in zip(rows, fps):
        r = find(f)
        if i is not None and (low.get(r) is None or i < low[r]):
            low[r] = i
        low.setdefault(r, None)
    return sorted(((i, f"{f:016x}", low[find(f)]) for (i, _), f in zip(rows, fps)), key=str)


def test_triples_cover_every_four_positions():
    assert len(simhash.TRIPLES) == 20
    for four in combinations(range(8), 4):
        assert any(set(t) <= set(four) for t in simhash.TRIPLES)


def result(df):
    return sorted(((r._id, f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in df.collect()), key=str)


def test_query_matches_brute_force(spark):
    docs = read_table(spark, SF_SMALL, "documents")
    want = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    got = sorted((tuple(r) for r in queries.op2_simhash(spark, SF_SMALL).collect()), key=str)
    assert got == want


def test_awkward_rows(spark):
    texts = awkward_texts()
    assert result(simhash.simhash_components(frame(spark, texts))) == brute_components(texts)


def test_long_lists_give_the_same_components(spark, monkeypatch):
    rng = random.Random(3)
    near = sentence(rng, 200).split()
    texts = []
    for i in range(260):
        words = list(near)
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(200)] = f"w{rng.randrange(90)}"
        texts.append(" ".join(words))
    texts = [(i, t) for i, t in enumerate(texts)]
    want = brute_components(texts)
    assert result(simhash.simhash_components(frame(spark, texts))) == want
    monkeypatch.setattr(simhash, "LONG", 8)
    monkeypatch.setattr(simhash, "PIECE", 16)
    assert result(simhash.simhash_components(frame(spark, texts))) == want


def test_links_of_random_codes(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 30, dtype=np.int64)
    fps = set(base.tolist())
    for f in base.tolist():
        for _ in range(6):
            for b in rng.choice(64, rng.integers(1, 7), replace=False).tolist():
                f ^= 1 << b
            f = (f + (1 << 63)) % (1 << 64) - (1 << 63)
            fps.add(f)
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"))
    roots = {r.node: r.root for r in graph.components(found).collect()}
    want = {f: {f} for f in fps}
    for a, b in combinations(sorted(fps), 2):
        if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4 and want[a] is not want[b]:
            want[a] |= want[b]
            for x in want[b]:
                want[x] = want[a]
    assert {f: roots.get(f, f) for f in fps} == {f: min(want[f]) for f in fps}


def test_components_of_a_long_chain(spark):
    n = 300
    order = random.Random(2).sample(range(n), n)
    edges = [(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001), (1001, 1001)]
    out = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.root) for r in out) == [(i, 0) for i in range(n)] + [(1000, 1000), (1001, 1000)]
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_empty_table(spark):
    out = simhash.simhash_components(spark.createDataFrame([], SCHEMA))
    assert out.collect() == []


def test_one_row_of_each_component_stays(spark):
    own = {i: t for i, t in reversed(awkward_texts())}
    texts = [*own.items(), *list(own.items())[5:8]]   # repeated rows
    docs = frame(spark, texts)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    comp = {(i, fp): c for i, fp, c in brute_components(texts)}
    got = [(r.doc_id, f"{brute_fingerprint(r.text):016x}") for r in rows]
    assert len(got) == len(set(got))
    assert sorted(str(comp[g]) for g in got) == sorted({str(c) for c in comp.values()})
    assert all(comp[g] in (g[0], None) for g in got)


@pytest.mark.parametrize("text", ["", "a", "a b c", "a b c d", "x " * 9])
def test_fingerprint_of_short_texts(text):
    assert simhash.fingerprint(text.encode().split()) & (1 << 64) - 1 == brute_fingerprint(text)
