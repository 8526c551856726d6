import random
import re

import numpy as np
import pytest

from rota.llm import decontam, queries
from rota.sources.tables import read_table
from tests.conftest import SF_SMALL
from tests.llm.corpus import SCHEMA, awkward_texts, frame, sentence

ITEM = "item_id long, text string, hits string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(
        c.lower() if c.isascii() else c for c in text or ""))


def brute_covered(doc, item):
    """Words of item under five-word runs that stand in doc; the most that tiles
    can cover, and what they do cover where runs don't compete."""
    runs = {tuple(doc[i:i + 5]) for i in range(len(doc) - 4)}
    return len({p for i in range(len(item) - 4) if tuple(item[i:i + 5]) in runs for p in range(i, i + 5)})


def brute(docs, items):
    out = []
    for doc, text in docs:
        found = []
        for i, t in items:
            w = words(t)
            if len(w) >= 5 and (share := brute_covered(words(text), w) / len(w)) >= 0.8:
                found.append((i, share))
        out.append((doc, sorted(found)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, [(h.item_id, h.coverage) for h in r.hits]) for r in df.collect()), key=str)


def literal_tiles(doc, item, minimum=5):
    """Greedy string tiling as defined: mark the longest unmarked common runs,
    one length after the other."""
    md, mi, out = set(), set(), []
    while True:
        best, at = minimum - 1, []
        for i in range(len(doc)):
            for j in range(len(item)):
                n = 0
                while (i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n]
                       and i + n not in md and j + n not in mi):
                    n += 1
                if n > best:
                    best, at = n, [(i, j)]
                elif n == best and n >= minimum:
                    at.append((i, j))
        if best < minimum:
            return out
        for i, j in at:
            d, e = set(range(i, i + best)), set(range(j, j + best))
            if not d & md and not e & mi:
                md |= d
                mi |= e
                out.append((i, j, best))


@pytest.mark.parametrize("seed", range(12))
def test_tiles_follow_the_definition(seed):
    rng = np.random.default_rng(seed)
    letters = [3, 6, 40][seed % 3]
    doc = rng.integers(0, letters, rng.integers(0, 60)).astype(np.uint64)
    item = rng.integers(0, letters, rng.integers(5, 40)).astype(np.uint64)
    got = decontam.tiles(doc, item)
    cells_d = [x for d, _, n in got for x in range(d, d + n)]
    cells_i = [x for _, i, n in got for x in range(i, i + n)]
    assert len(set(cells_d)) == len(cells_d) and len(set(cells_i)) == len(cells_i)
    assert all(n >= 5 and (doc[d:d + n] == item[i:i + n]).all() for d, i, n in got)
    want = literal_tiles(doc.tolist(), item.tolist())
    assert max((n for *_, n in got), default=0) == max((n for *_, n in want), default=0)
    if letters == 40:
        assert sum(n for *_, n in got) == sum(n for *_, n in want)


def test_reordered_passage_is_covered():
    rng = random.Random(1)
    item = [f"t{i}" for i in range(40)]
    doc = sentence(rng, 30).split() + item[25:] + sentence(rng, 8).split() + item[:25]
    found = decontam.Items([(7, " ".join(item))]).hits(
        decontam.WordHashes().of([w.encode() for w in doc]), 0.8)
    assert found == [(7, 1.0)]


def test_query_matches_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in read_table(spark, SF_SMALL, "documents").collect()]
    items = [(r.item_id, r.text) for r in read_table(spark, SF_SMALL, "benchmark").collect()]
    got = sorted(((r.doc_id, r.contaminated, r.coverage, r.item_ids)
                  for r in queries.op4_decontaminate(spark, SF_SMALL).collect()), key=str)
    want = sorted(((d, bool(f), max((c for _, c in f), default=0.0), [i for i, _ in f])
                   for d, f in brute(docs, items)), key=str)
    assert got == want and any(c for _, c, _, _ in got)


@pytest.mark.parametrize("limit", [1 << 24, 300])
def test_awkward_rows_in_one_and_many_blocks(spark, monkeypatch, limit):
    texts = awkward_texts()
    passage = texts[46][1]
    items = [(1, passage), (2, None), (3, ""), (4, "only four words here"), (5, passage.upper()),
             (None, "a b c d e f g"), (6, " ".join(reversed(passage.split()))), (1, passage),
             (8, texts[0][1])]
    texts += [(5000, "x a B c, d e f g."), (5001, " ".join(passage.split()[:40]))]
    docs = frame(spark, texts).withColumnRenamed("_key", "hits")
    bench = spark.createDataFrame([(*i, "x") for i in items], ITEM)
    blocks = decontam._blocks
    monkeypatch.setattr(decontam, "_blocks", lambda b, i, t: blocks(b, i, t, limit))
    out = decontam.contamination(docs, bench, out="found")
    assert out.columns == [*docs.columns, "found"]
    got = sorted(((r.doc_id, sorted(((h.item_id, h.coverage) for h in r.found), key=str))
                  for r in out.collect()), key=str)
    want = sorted(((d, sorted(set(f), key=str)) for d, f in brute(
        texts, [(i, t) for i, t in dict.fromkeys(items)])), key=str)
    assert [(d, sorted(set(f), key=str)) for d, f in got] == want
    kept = decontam.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not f for _, f in want)


def test_empty_tables(spark):
    none, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], ITEM)
    assert decontam.contamination(none, bench).collect() == []
    out = decontam.contamination(frame(spark, ["a b c d e f", None]), bench).collect()
    assert [r.hits for r in out] == [[], []]


def test_items_without_id_and_repeated_items(spark):
    text = "one two three four five six seven eight"
    docs = frame(spark, [(1, text)])
    items = spark.createDataFrame([(None, text, "x"), (7, text, "x"), (7, text, "y"), (None, text, "x"),
                                   (2, None, None)], ITEM)
    assert result(decontam.contamination(docs, items)) == [(1, [(None, 1.0), (7, 1.0)])]


def test_items_shorter_than_a_tile(spark):
    docs = frame(spark, [(1, "see Only four, words here now"), (2, "only four words there here"),
                         (3, "zebra"), (4, ""), (5, "one two three four five zebra")])
    items = spark.createDataFrame([(1, "only four words here", "x"), (2, "Zebra", "x"), (3, "", "x"),
                                   (4, "one two three four five", "x")], ITEM)
    assert result(decontam.contamination(docs, items)) == [
        (1, [(1, 1.0)]), (2, []), (3, [(2, 1.0)]), (4, []), (5, [(2, 1.0), (4, 1.0)])]
