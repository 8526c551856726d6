"""Small corpora with the awkward cases, shared by the tests of this folder."""

from __future__ import annotations

import random

from rota.sources.tables import read_table
from tests.conftest import SF_SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, fp string"

VOCABULARY = ("the of and river stone house light green winter summer paper water glass mountain "
              "träume été niño straße token login people science engine music").split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def rows(texts, first_id: int = 0):
    """Rows of ``SCHEMA`` for (id, text) pairs or texts; other columns vary and are
    NULL at times, two have names that operators use inside."""
    out = []
    for i, t in enumerate(texts):
        doc, text = t if isinstance(t, tuple) else (first_id + i, t)
        out.append((doc, text, None if i % 7 == 3 else "en" if i % 3 else "de",
                    None if i % 11 == 5 else "hot" if i % 3 else f"s{i % 5}",
                    len(text) if text is not None else None, "clash", "clash"))
    return out


def frame(spark, texts):
    return spark.createDataFrame(rows(texts), SCHEMA).repartition(3)


def awkward_texts(seed: int = 1) -> list:
    """(id, text): empty, NULL, blank and one-word texts, copies, near copies, a
    long text, a repeated row, an id with two texts, a NULL id."""
    rng = random.Random(seed)
    base = [sentence(rng, rng.randint(1, 120)) for _ in range(40)]
    passage = sentence(rng, 60)
    texts = base + ["", None, "   \t\n", "word", None, "\x0b\x0c", passage]
    texts += [base[5], base[5], base[6].upper()]
    texts += [f"{sentence(rng, 20)}\n{passage}\n{sentence(rng, 15)}" for _ in range(12)]
    near = sentence(rng, 300).split()
    for i in range(12):
        words = list(near)
        words[rng.randrange(300)] = f"w{i}"
        texts.append(" ".join(words))
    texts.append(sentence(rng, 30_000))
    out = [(i * 3 % 997, t) for i, t in enumerate(texts)]
    out += [out[2], (out[3][0], base[9]), (None, base[10]), (None, None)]
    return out


def sample_docs(spark):
    """The given small table and the awkward texts under other ids."""
    given = [(r["doc_id"], r["text"]) for r in read_table(spark, SF_SMALL, "documents").collect()]
    return given + [(None if i is None else i + 10_000, t) for i, t in awkward_texts()]
