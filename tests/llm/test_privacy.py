import math
import random
import re

from rota.llm import privacy, queries
from rota.sources.tables import read_table
from tests.conftest import SF_ORACLE
from tests.llm import spans_brute as brute
from tests.llm.corpus import SCHEMA, awkward_texts, frame, sentence

KINDS = ("email", "ip", "card", "phone")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
BITS = ["a@b.co", "x.y@", "@", "me@host.example.com", ".", "..", "a@b.c_x@d.e", "1.2.3.4", "256.1.1.1",
        "1.2.3.4.5.6.7.8", "4111 1111 1111 1111", "4111-1111-1111-1111", "1234567890123", "0000000000000000",
        "+1 (017) 555-7713", "+49", "555", "-", " ", "  ", "é", "ß", "\n", "", "\U0001f600", "7" * 25,
        "+12345678901234567", "word", "name", "001.002.003.004"]


def noise(rng):
    return "".join(rng.choice(BITS) for _ in range(rng.randint(1, 30)))


def lower(word):
    return word.lower()


def digits(s):
    return re.sub("[^0-9]", "", s)


def entities(kind, value):
    group = {"email": lambda: value.rsplit("@", 1)[-1].lower(), "ip": lambda: value.rsplit(".", 1)[0],
             "card": lambda: digits(value)[:6], "phone": lambda: digits(value)[:-4]}[kind]()
    return [("value", kind, value), ("group", kind, group), ("kind", kind)]


def outside(text, base):
    """Words with places outside the base spans."""
    chars = list(text)
    for a, _, z in base:
        chars[a:z] = " " * (z - a)
    return [(lower(m[0]), m.start(), m.end()) for m in WORD.finditer("".join(chars))
            if m.end() - m.start() >= privacy.SHORTEST]


def low(k, n, z=privacy.CONFIDENCE):
    p = k / n
    return (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def bits(k, n, prior):
    part = lambda a, b: a * math.log2(a / b) if a > 0 else 0.0
    return n * (part(k / n, prior) + part(1 - k / n, 1 - prior))


def estimates(rows):
    """(entity, term) -> disclosure of the pairs with evidence, every pair counted."""
    docs = {(i, t or "") for i, t in rows}
    holds, said = {}, {}
    for d in docs:
        base = [s for k in KINDS for s in brute.personal(d[1])[k]]
        for a, k, z in base:
            for e in entities(k, d[1][a:z]):
                holds.setdefault(e, set()).add(d)
        for w, *_ in outside(d[1], base):
            said.setdefault(w, set()).add(d)
    classes = {}
    for e, ds in holds.items():
        classes.setdefault(frozenset(ds), []).append(e)
    pairs = {}
    for ds, es in classes.items():
        for w in {w for d in ds for w, *_ in outside(d[1], [s for k in KINDS for s in brute.personal(d[1])[k]])}:
            near = sum(any(d in x for x in holds.values()) for d in said[w])
            if len(ds) >= 3 and near >= 3 and near >= 0.5 * len(said[w]) and len(ds) >= 0.5 * len(said[w]):
                pairs[ds, w] = len(said[w] & ds), len(said[w])
    told = {}
    for (ds, w), (k, n) in pairs.items():
        prior = len(ds) / len(docs)
        if (prior < 1 and k / n > prior and low(k, n) >= privacy.EVIDENCE - 1e-9
                and bits(k, n, prior) >= math.log2(len(pairs) / privacy.CHANCE) - 1e-9):
            for e in classes[ds]:
                told[e, w] = 1 + math.log2(k / n) / -math.log2(prior)
    return told


def want(rows):
    told, out = estimates(rows), []
    for i, t in rows:
        t = t or ""
        base = [s for k in KINDS for s in brute.personal(t)[k]]
        mine = {e for a, k, z in base for e in entities(k, t[a:z])}
        extra = []
        for w, a, z in outside(t, base):
            most = max((told.get((e, w), -1) for e in mine), default=-1)
            if most >= privacy.GENERALISE - 1e-9:
                extra.append(("remove" if most >= privacy.REMOVE - 1e-9 else "generalise", a, z))
        extra = [(a, k, z) for k, a, z in sorted(extra, key=lambda x: (x[0] == "generalise", x[1]))]
        out.append((i, *[sum(s[1] == k for s in base) for k in KINDS], brute.digest(base), brute.shown(base + extra)))
    return sorted(out, key=str)


def result(found):
    return sorted((tuple(r) for r in queries._span_digest(found, KINDS).collect()), key=str)


def test_query_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF_ORACLE, "documents").collect()]
    got = sorted((tuple(r) for r in queries.op10_privacy(spark, SF_ORACLE).collect()), key=str)
    assert got == want(rows) and all(any(r[c] for r in got) for c in range(1, 5))


def planted():
    rng = random.Random(8)
    rows = awkward_texts() + [(20_000 + i, noise(rng)) for i in range(300)]
    for i in range(40):
        given = "quill" + "abcd"[i % 4]
        rows.append((21_000 + i, f"{sentence(rng, 30)} {given} harbour me{i % 4}@host.example.com {sentence(rng, 9)}"))
    rows += [(22_000 + i, f"harbour {sentence(rng, 12)}") for i in range(60)]
    rows += [rows[90], (23_000, "9" * 20_000), (23_001, "a" * 20_000 + "@"), (23_002, "+1" * 4000),
             (23_003, "4111 1111 1111 1111 " * 200)]
    return rows


def test_awkward_rows_and_noise(spark):
    rows = planted()
    got = result(privacy.scan_private(frame(spark, rows)))
    assert got == want(rows)
    assert any("remove" in r[-1] for r in got)


def test_sanitised_texts(spark):
    docs = frame(spark, [(1, "mail a@b.co now"), (2, None), (3, "clean"), (4, ""), (5, "ip 10.0.0.1, +1 (017) 555-7713")])
    out = privacy.sanitise(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {
        1: "mail [EMAIL] now", 2: None, 3: "clean", 4: "", 5: "ip [IP], [PHONE]"}


def test_one_document_is_no_evidence(spark):
    """What stands in a single document says nothing, however rare it is."""
    rows = [(1, "ask quillon stone at me@host.example.com house")]
    rows += [(2 + i, "water stone house summer") for i in range(20)]
    spans = {r[0]: r[-1] for r in result(privacy.scan_private(frame(spark, rows)))}
    assert spans.pop(1) == "email:21:40" and not any(spans.values())


def test_repeated_rows_change_nothing(spark):
    rows = planted()
    once = result(privacy.scan_private(frame(spark, list(dict.fromkeys(rows)))))
    many = result(privacy.scan_private(frame(spark, rows + rows + rows[300:])))
    assert set(many) == set(once) and len(many) == 2 * len(rows) + len(rows) - 300


def test_rare_values_back_off_to_their_host(spark):
    """Every address stands in one document; the host's documents carry the evidence."""
    rng = random.Random(2)
    rows = [(i, f"{sentence(rng, 20)} Vellum u{i}@corp.example.org 77 {sentence(rng, 20)}") for i in range(8)]
    rows += [(100 + i, f"{sentence(rng, 30)} x{i}@mail.example.com {sentence(rng, 9)}") for i in range(30)]
    rows += [(200 + i, sentence(rng, 40)) for i in range(100)]
    found = result(privacy.scan_private(frame(spark, rows)))
    assert found == want(rows)
    for r in found:
        at = [s.split(":")[0] for s in r[-1].split(",")]
        assert at == (["email", "remove", "remove"] if r[0] < 100 else ["email"] if r[0] < 200 else [""])


def test_planted_terms_go_and_ordinary_words_stay(spark):
    """Names, short ones and numbers that stand with one address only are found; no
    word that stands anywhere else is."""
    rng = random.Random(9)
    rows = [(i, sentence(rng, rng.randint(20, 200))) for i in range(400)]
    for p in range(12):
        for j in range(6):
            rows.append((1000 + 10 * p + j, f"{sentence(rng, 30)} Oz{p} case 9{p:03} name{p} mail p{p}@h.example.com "
                                            f"{sentence(rng, 60)} nick{p}"))
    found = result(privacy.scan_private(frame(spark, rows)))
    assert found == want(rows)
    texts, gone = dict(rows), set()
    for r in found:
        for kind, a, z in (s.split(":") for s in r[-1].split(",") if s):
            if kind in ("remove", "generalise"):
                gone.add(texts[r[0]][int(a):int(z)].lower())
    named = {f"{w}{p}" for p in range(12) for w in ("oz", "name", "nick")} | {f"9{p:03}" for p in range(12)}
    assert named <= gone and gone <= named | {"case", "mail"}   # these two stand with addresses alone


def test_a_list_of_addresses_is_not_paired_with_every_word(spark):
    """1,500 addresses and words in one document, and given whole in three more."""
    for copies in (1, 4):
        listed = " ".join(f"a{i}@h{i % 9}.example.com word{i}" for i in range(1500))
        rows = [(i, f"{listed} no{i}") for i in range(copies)] + [(100 + i, f"water {i}") for i in range(50)]
        docs = frame(spark, rows)
        found = privacy.candidates(docs, "doc_id", "text").checkpoint().where("size(base) > 0")
        classes = privacy.entity_classes(found, 3)
        assert classes.count() == (0 if copies == 1 else copies)
        spans = {r[0]: r[-1] for r in result(privacy.scan_private(docs))}
        assert spans[0].count("remove:") == (0 if copies == 1 else 1500)


def test_terms_far_from_the_mention(spark):
    far = "water stone house summer " * 30
    rows = [(i, f"Quillon {far}me@host.example.com {far}quillon") for i in range(3)]
    rows += [(10 + i, far) for i in range(20)]
    end = 8 + len(far) + 20 + len(far)
    spans = {r[0]: r[-1] for r in result(privacy.scan_private(frame(spark, rows)))}
    for i in range(3):
        assert spans[i].split(",")[1:] == ["remove:0:7", f"remove:{end}:{end + 7}"]


def test_empty_table(spark):
    assert privacy.scan_private(spark.createDataFrame([], SCHEMA)).collect() == []
