import re

import corpus_pipeline
from rota.llm import queries
from rota.sources.tables import read_table
from tests.conftest import SF_SMALL
from tests.llm.corpus import awkward_texts
from tests.llm.test_credentials import brute_base, brute_weak
from tests.llm.test_decontam import brute as contaminated
from tests.llm.test_packing import check
from tests.llm.test_simhash import brute_components


def stages(spark, docs, sf_dir):
    """(name, rows before, rows after) of every stage, each on what was kept."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, sf_dir)
        out.append((name, docs, done))
        docs = spark.createDataFrame(done.collect(), done.schema)
    return out


def check_stages(spark, docs, sf_dir):
    found = stages(spark, docs, sf_dir)
    columns = docs.columns
    assert all(done.columns == columns for _, _, done in found[:-1])
    pairs = {name: ([tuple(r) for r in a.collect()], [tuple(r) for r in b.collect()]) for name, a, b in found}
    text = lambda rows: [(r[0], r[1]) for r in rows]

    before, after = pairs["quality_classifier"]
    assert set(after) <= set(before)

    before, after = pairs["simhash_near_dedup"]
    comp = brute_components(text(before))
    assert len(after) == len({c for _, _, c in comp}) and {r[0] for r in after} == {c for _, _, c in comp}

    before, after = pairs["benchmark_decontamination"]
    items = [(r.item_id, r.text) for r in read_table(spark, sf_dir, "benchmark").collect()]
    clean = {d for d, hits in contaminated(text(before), items) if not hits}
    assert sorted(after) == sorted(r for r in before if r[0] in clean)

    before, after = pairs["secret_scan"]
    want = []
    for r in before:
        spans = sorted(brute_base(r[1]) + brute_weak(r[1]))
        t, at, out = r[1], 0, []
        for a, kind, b in spans:
            if a >= at:
                out += [t[at:a], corpus_pipeline.credentials.LABELS[kind]]
            at = max(at, b)
        t = "".join([*out, t[at:]]) if spans else t
        want.append((r[0], t, r[2], r[3], len(t) if spans else r[4], *r[5:]))
    assert sorted(after, key=str) == sorted(want, key=str)
    assert not any(re.search("AKIA[A-Z0-9]{14}|[0-9a-f]{16}", r[1] or "") for r in after)

    before, _ = pairs["best_fit_packing"]
    check(text(before), found[-1][2].collect())


def test_stages_match_brute_force(spark):
    check_stages(spark, read_table(spark, SF_SMALL, "documents"), SF_SMALL)


def test_awkward_rows(spark):
    own = {i: t for i, t in reversed(awkward_texts()) if i is not None}
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in own.items()]
    schema = read_table(spark, SF_SMALL, "documents").schema
    check_stages(spark, spark.createDataFrame(rows, schema), SF_SMALL)


def test_run_gives_the_rows_of_the_last_stage(spark):
    last = stages(spark, read_table(spark, SF_SMALL, "documents"), SF_SMALL)[-1][2]
    key = lambda df: sorted((r.doc_id, r.piece, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF_SMALL)) == key(last)
    assert queries.queries() and corpus_pipeline.ORACLE_SQL is None


def test_empty_documents(spark):
    schema = read_table(spark, SF_SMALL, "documents").schema
    docs = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        done = stage(spark, docs, SF_SMALL)
        assert done.collect() == []
        docs = spark.createDataFrame([], done.schema)
