"""License scan: an exact set-similarity join of text blocks with license templates.

Blocks are windows of consecutive words, wherever lines end; templates a short
list of notices. A template of m words is compared with every window of m and a
quarter more words (``window``; two more at least), so its words must stand close
together, and a text that is shorter is one block. A block meets a template when
it contains at least ``CONTAINMENT`` of the template's distinct words.

The words of the templates are ordered by how many documents of the corpus hold
them, rarest first; all other words come before them. With n words and c of them
needed, a block that meets the template holds one of its n - c + 1 rarest words
(prefix filter). Its shared words all lie at or after the first of them in that
order, so where fewer than c places around that word hold such words, no block does
(positional filter). A block has at least c words, at most ``window`` of them
(length filter). What passes is counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rota.llm.words import ALNUM_LOWER, alnum_words

CONTAINMENT = 0.8

# The phrases that count wherever their words follow each other.
PHRASES = (("mit license", "mit"), ("apache license", "apache"),
           ("general public license", "gpl"))

# Usual short notices and opening sentences, by label. Of four
# words or fewer all are needed, so short notices are listed by their telling
# words, none of which a block may lack.
TEMPLATES = (
    ("mit", "under the mit license"),
    ("mit", "released under the mit"),
    ("mit", "licensed under the mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this "
            "software and associated documentation files"),
    ("apache", "apache license version 2"),
    ("apache", "under apache version 2"),
    ("apache", "you may not use this file except in compliance with the license"),
    ("gpl", "gnu general public license"),
    ("gpl", "gnu public license version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the "
            "terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are "
            "permitted provided that the following conditions are met"),
    ("cc-by-nc", "cc by nc 4"),
    ("cc-by-sa", "cc by sa 4"),
    ("cc-by", "creative commons attribution international"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or "
            "without fee is hereby granted"),
    ("rights", "all rights reserved"),
)


def _words(text: str) -> list[bytes]:
    return alnum_words(text.encode())


def word_counts(docs: DataFrame, vocabulary: Sequence[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How many documents hold each word of a short list: counted per task,
    summed in Spark, one row per listed word."""
    listed = list(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = frozenset(listed), dict.fromkeys(listed, 0)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                for text in batch.column(0).slice(i, 256).to_pylist():
                    for w in wanted.intersection(alnum_words(text)):
                        seen[w] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())],
            names=["word", "n"])

    parts = docs.select(F.col(text_col).cast("binary")).mapInArrow(count, "word binary, n long")
    found = {bytes(r["word"]): r["n"] for r in parts.groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(w, 0) for w in listed}


def window(n_words: int) -> int:
    """Words of the blocks that a template of ``n_words`` words is compared with."""
    return n_words + max(2, math.ceil(n_words / 4))


class Templates:
    """Templates with their words in the global order, and an index of prefixes."""

    def __init__(self, templates: Sequence[tuple[str, str]], counts: dict[bytes, int],
                 containment: float):
        order = sorted({w for _, t in templates for w in _words(t)}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: r for r, w in enumerate(order)}
        self.rows, self.prefix = [], {}
        for label, text in templates:
            ranks = sorted({self.rank[w] for w in _words(text)})
            need = max(math.ceil(containment * len(ranks) - 1e-9), 1)
            for r in ranks[:len(ranks) - need + 1]:
                self.prefix.setdefault(r, []).append(len(self.rows))
            self.rows.append((label, frozenset(ranks), need, window(len(_words(text)))))
        self.signs = tuple(order[r] for r in self.prefix)

    def meet(self, words: list[bytes]) -> list[tuple[str, float]]:
        """(label, greatest containment in a block) of the templates that a text meets."""
        ranks = [self.rank.get(w, -1) for w in words]
        areas: dict[int, list[list[int]]] = {}   # template -> stretches of blocks that hold a prefix word
        for i, r in enumerate(ranks):
            for t in self.prefix.get(r, ()):
                _, _, need, wide = self.rows[t]
                lo, hi = max(i - wide + 1, 0), min(i + wide, len(ranks))
                if hi - lo < need or sum(x >= r for x in ranks[lo:hi]) < need:
                    continue
                found = areas.setdefault(t, [])
                if found and lo <= found[-1][1]:
                    found[-1][1] = hi
                else:
                    found.append([lo, hi])
        out = []
        for t, stretches in areas.items():
            label, wanted, need, wide = self.rows[t]
            best = max(_most(ranks, wanted, wide, lo, hi) for lo, hi in stretches)
            if best >= need:
                out.append((label, best / len(wanted)))
        return out


def _most(ranks: list[int], wanted: frozenset[int], wide: int, lo: int, hi: int) -> int:
    """Most distinct words of ``wanted`` in any ``wide`` consecutive places from lo to hi."""
    last: dict[int, int] = {}
    best = 0
    for i in range(lo, hi):
        if ranks[i] in wanted:
            last[ranks[i]] = i
            best = max(best, sum(at > i - wide for at in last.values()))
            if best == len(wanted):
                break
    return best


def _base(text: bytes, phrases) -> tuple[int, int, int | None, int | None, set[str]]:
    """(words, places, first, last, labels) of the phrases in an ALNUM_LOWER text."""
    words = text.split()
    starts, labels = [], set()
    for phrase, label in phrases:
        if phrase[-1] not in text:
            continue
        at = [i for i in range(len(words) - len(phrase) + 1)
              if words[i] == phrase[0] and words[i:i + len(phrase)] == phrase]
        if at:
            labels.add(label)
            starts += at
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), labels)


_SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, "
           "base_labels string, labels string, score double")


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: Sequence[tuple[str, str]] = TEMPLATES,
                  phrases: Sequence[tuple[str, str]] = PHRASES,
                  containment: float = CONTAINMENT) -> DataFrame:
    """One row per input row: ``doc_id``, words, places where a phrase stands,
    smallest and largest of them, its labels, these with the labels of templates
    that a block meets, and the best containment found (1 where a phrase stands,
    0 where nothing was found). NULL and empty texts: 0 words, empty labels,
    score 0. The templates are a parameter of the call and small, so they
    travel with the tasks."""
    vocabulary = sorted({w for _, t in templates for w in _words(t)})
    ready = Templates(templates, word_counts(docs, vocabulary, text_col), containment)
    split = [(_words(p), label) for p, label in phrases]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                rows = []
                for text in part.column(1).to_pylist():
                    text = text or b""
                    plain = text.translate(ALNUM_LOWER)
                    n, base, first, last, labels = _base(plain, split)
                    best, more = float(base > 0), set(labels)
                    if any(w in plain for w in ready.signs):
                        for label, share in ready.meet(plain.split()):
                            more.add(label)
                            best = max(best, share)
                    rows.append((n, base, first, last, ",".join(sorted(labels)),
                                 ",".join(sorted(more)), best))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)] + [pa.array([r[c] for r in rows], k) for c, k in enumerate(kinds)],
                    names=[c.split()[0] for c in _SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("t")).mapInArrow(scan, _SCHEMA)
