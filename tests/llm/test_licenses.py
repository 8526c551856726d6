import math
import random
import textwrap

import duckdb
import pytest

from rota.llm import licenses, oracle, queries
from rota.sources.tables import read_table
from tests.conftest import SF_SMALL
from tests.llm.corpus import SCHEMA, awkward_texts, frame, sentence
from tests.llm.test_decontam import words


def brute(rows, templates=licenses.TEMPLATES, phrases=licenses.PHRASES):
    out = []
    for doc, text in rows:
        w = words(text)
        at, labels = [], set()
        for phrase, label in phrases:
            p = words(phrase)
            hits = [i for i in range(len(w)) if w[i:i + len(p)] == p]
            at += hits
            labels |= {label} if hits else set()
        more, best = set(labels), float(bool(at))
        for label, t in templates:
            want, wide = set(words(t)), licenses.window(len(words(t)))
            shared = max(len(want.intersection(w[i:i + wide])) for i in range(max(len(w), 1)))
            if shared >= math.ceil(licenses.CONTAINMENT * len(want) - 1e-9):
                more.add(label)
                best = max(best, shared / len(want))
        out.append((doc, len(w), len(at), min(at, default=None), max(at, default=None),
                    ",".join(sorted(labels)), ",".join(sorted(more)), best))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF_SMALL, "documents").collect()]
    got = result(queries.op6_licenses(spark, SF_SMALL))
    assert got == brute(rows) and any(r[2] for r in got)


def mixed_rows():
    rng = random.Random(6)
    rows = awkward_texts()
    for i in range(150):
        words_ = rng.choice(licenses.TEMPLATES)[1].split()
        for _ in range(rng.randint(0, 5)):
            words_.insert(rng.randrange(len(words_) + 1), rng.choice(["x", "\n", "MIT", "éa", "the"]))
        for _ in range(rng.randint(0, 4)):
            words_.pop(rng.randrange(len(words_)))
        rng.random() < 0.2 and rng.shuffle(words_)
        rows.append((40_000 + i, rng.choice([" ", "-", ". "]).join(words_)))
    return rows + [(50_000, "mit mit license license"), (50_001, "MIT\nLicense"), (50_002, "mitlicense"),
                   (50_003, "Apache License " * 300),
                   (50_004, "all x rights\n\nreserved " * 200), rows[60]]


def test_awkward_rows(spark):
    rows = mixed_rows()
    assert result(licenses.scan_licenses(frame(spark, rows))) == brute(rows)


def test_oracle_on_awkward_rows(spark):
    rows = {i: t for i, t in mixed_rows() if i is not None}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(rows.items()))
    got = con.execute(oracle.oracle_sql()["op6_licenses"]).fetchall()
    assert sorted(got, key=str) == brute(list(rows.items()))


def test_each_notice_gets_its_own_label_only(spark):
    notices = [("Released under the MIT License.", "mit"),
               ("Licensed under the MIT License.", "mit"),
               ("Licensed under the Apache License, Version 2.0.", "apache"),
               ("This work is licensed under the GNU General Public License, version 3.", "gpl"),
               ("Licensed under CC BY-NC 4.0", "cc-by-nc"), ("Licensed under CC BY-SA 4.0", "cc-by-sa"),
               ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
               ("Licensed under the License, Version 2.0", "")]
    got = licenses.scan_licenses(frame(spark, [n for n, _ in notices])).orderBy("doc_id").collect()
    assert [r.labels for r in got] == [label for _, label in notices]


def test_empty_table_and_no_templates(spark):
    assert licenses.scan_licenses(spark.createDataFrame([], SCHEMA)).collect() == []
    out = licenses.scan_licenses(frame(spark, ["the mit license"]), templates=())
    assert result(out) == [(0, 3, 1, 1, 1, "mit", "mit", 1.0)]


NOTICES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
           'and associated documentation files (the "Software"), to deal in the Software without restriction',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted "
           "provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
           "fee is hereby granted, provided that the above copyright notice appear in all copies",
    "apache": "you may not use this file except in compliance with the License. You may obtain a copy at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the "
           "GNU General Public License as published by the Free Software Foundation",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."}


@pytest.mark.parametrize("mark", ["", " * ", "# ", "// "])
def test_wrapped_notices(spark, mark):
    rng = random.Random(3)
    rows = [(i, f"{sentence(rng, 400)}\n" + "\n".join(textwrap.wrap(
        notice, width, initial_indent=mark, subsequent_indent=mark)) + f"\n{sentence(rng, 400)}")
        for i, (notice, width) in enumerate((n, w) for n in NOTICES.values() for w in (30, 75))]
    got = licenses.scan_licenses(frame(spark, rows)).orderBy("doc_id").collect()
    assert [r.labels for r in got] == [label for label in NOTICES for _ in range(2)]
    assert all(r.score >= licenses.CONTAINMENT for r in got)


def test_scattered_words_are_no_notice(spark):
    texts = ["the license of this blog is apache like a helicopter, see version notes from page 2 of the book",
             "we went under the bridge with mit students, and the license of the car",
             "all the people had their rights and seats were reserved"]
    rng = random.Random(4)
    texts += [" ".join(rng.sample(t := n.split() + sentence(rng, 300).split(), len(t)))
              for n in NOTICES.values()]
    got = licenses.scan_licenses(frame(spark, texts)).collect()
    assert [(r.labels, r.score) for r in got] == [("", 0.0)] * len(texts)


@pytest.mark.parametrize("seed", range(5))
def test_filters_lose_no_block(seed):
    rng = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    templates = [(str(i), " ".join(rng.choice(letters[:16]) for _ in range(rng.randint(1, 9))))
                 for i in range(12)]
    ready = licenses.Templates(templates, {c.encode(): rng.randint(0, 9) for c in letters}, 0.7)
    for _ in range(200):
        text = [rng.choice(letters).encode() for _ in range(rng.choice([0, 1, 5, 12, 60, 200]))]
        want = []
        for label, t in templates:
            words_, wide = set(licenses._words(t)), licenses.window(len(t.split()))
            shared = max((len(words_.intersection(text[i:i + wide])) for i in range(len(text))), default=0)
            if shared / len(words_) >= 0.7 - 1e-9:
                want.append((label, shared / len(words_)))
        assert sorted(ready.meet(text)) == sorted(want)
