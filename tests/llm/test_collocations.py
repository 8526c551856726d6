import random
import re
from collections import Counter

import pytest

from rota.llm import collocations, queries
from rota.sources.tables import read_table
from tests.conftest import SF_ORACLE, SF_SMALL
from tests.llm.corpus import SCHEMA, awkward_texts, frame, rows as corpus_rows, sentence

LOWER = {i: i + 32 for i in range(0x41, 0x5B)}


def brute(rows, support, top=2000, longest=5, subsumed=100):
    """(lang, text) rows -> result rows, phrase by phrase in plain Python."""
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i:i + k])) for i in range(len(words) - k + 1))
    out = []
    known = {key: a for key, a in f.items() if a >= support}
    longer = Counter()
    for (lang, words), a in known.items():
        for m in range(2, len(words)):
            for s in range(len(words) - m + 1):
                key = lang, words[s:s + m]
                longer[key] = max(longer[key], a)
    for (lang, words), a in known.items():
        if len(words) > 1 and not (longer[lang, words] and 100 * longer[lang, words] >= subsumed * a):
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, words[:k]] * f[lang, words[k:]]), k,
                                  f[lang, words[:k]], f[lang, words[k:]]) for k in range(1, len(words)))
            out.append((lang, -score, -a, " ".join(words).encode(), l, r, n[lang]))
    ranks, found = Counter(), []
    for lang, score, a, phrase, l, r, total in sorted(out):
        ranks[lang] += 1
        if ranks[lang] <= top:
            found.append((lang, ranks[lang], phrase.decode(), -a, l, r, total, -score))
    return found


def result(df):
    return sorted(tuple(r) for r in df.collect())


def given(spark, sf):
    return [(r.lang, r.text) for r in read_table(spark, sf, "documents").collect()]


def test_query_matches_brute_force(spark):
    got = result(queries.op11_collocations(spark, SF_ORACLE))
    assert got == brute(given(spark, SF_ORACLE), 100) and len(got) > 50


@pytest.mark.parametrize("support, longest, top, subsumed", [
    (12, 5, 2000, 100), (3, 3, 7, 60), (40, 2, None, 100), (1, 4, 50, 100)])
def test_other_parameters(spark, support, longest, top, subsumed):
    docs = read_table(spark, SF_SMALL, "documents").repartition(5)
    got = result(collocations.collocations(docs, support=support, longest=longest, top=top, subsumed=subsumed))
    assert got == brute(given(spark, SF_SMALL), support, top or 10**9, longest, subsumed)


def planted():
    rng = random.Random(3)
    texts = awkward_texts() + [
        (3000 + i, t) for i, t in enumerate(
            ["A b,a B.a\tb;  a b\x0bc\x0ca b\rz!a  b?", ".,;:!?\n", " ", "\x00 \x01 \x00 \x01", "É é É é",
             "new york city " * 40, "New York\nCity new york", "x " * 500, "no\x1fspace\x1fhere", "\U0001f600 ok " * 30,
             sentence(rng, 9000), "-".join("ab" * 9), "und und und"])]
    return texts + [texts[-4], texts[-4]]


def as_rows(texts):
    return [(r[2], r[1]) for r in corpus_rows(texts)]


def test_awkward_rows(spark):
    texts = planted()
    got = result(collocations.collocations(frame(spark, texts), support=8))
    assert got == brute(as_rows(texts), 8) and {r[0] for r in got} == {"und", "en", "de"}


def test_small_chunks_blocks_and_a_full_bitmap(spark, monkeypatch):
    """Many chunks a task, long texts in blocks, and a bitmap that lets nearly everything pass."""
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 50)
    monkeypatch.setattr(collocations, "_BLOCK", 16)
    monkeypatch.setattr(collocations, "FILTER_BITS", 8)
    texts = planted()
    got = result(collocations.collocations(frame(spark, texts), support=8))
    assert got == brute(as_rows(texts), 8)


def test_chunks_keep_pieces_whole(monkeypatch):
    import numpy as np
    import pyarrow as pa
    monkeypatch.setattr(collocations, "_BLOCK", 8)
    text = "aa bb cc dd ee ff gg hh. ii jj kk, " * 5 + "ll " * 40
    batch = pa.RecordBatch.from_arrays([pa.array(["x"]), pa.array([text.encode()])], names=["lang", "text"])
    seen = []
    for _, ids, vocabulary in collocations._chunks(iter([batch]), 4):
        assert ids[-1] == 0
        seen += [vocabulary.words[i] for i in ids.tolist()]
    pieces = " ".join(w.decode() if w else "|" for w in seen).split("|")
    assert [p.split() for p in pieces if p.strip()] == [p.split() for p in re.split("[.,]", text) if p.strip()]


def test_hot_phrase_over_many_partitions(spark):
    """Every partition is under the support; one phrase is a third of all words."""
    texts = [(i, "hot pair. " * (4 if i % 2 else 0) + f"w{i} hot w{i % 7}") for i in range(400)]
    docs = frame(spark, texts).repartition(40)
    assert result(collocations.collocations(docs, support=100)) == brute(as_rows(texts), 100)


def test_products_beyond_64_bits(spark):
    counts = spark.createDataFrame([(10**12, 3 * 10**12 + 1, 10**17, 10**12 + 7)], "l long, r long, total long, a long")
    (score,) = counts.select(collocations._score()).first()
    assert score == 1000 * (10**12 + 7) * 10**17 // (10**12 * (3 * 10**12 + 1))


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], SCHEMA)).collect() == []
