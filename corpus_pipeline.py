"""The corpus pipeline: raw documents to packed training sequences, in stages.

Each stage takes the rows the one before it kept and returns a DataFrame. All
but the last return the columns of ``documents``.

Edge cases, by stage: a NULL or empty text has a score like any other and stays
or goes by it; all such texts share one fingerprint, so one of them passes the
second stage. Of equal texts, and of repeated rows, one row stays, the one
with the smallest id (NULL last). What is left has no ties: one row per id and
text. Extra columns pass through to the last stage, whatever their names.
An empty table gives an empty result.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from rota.llm import credentials, decontam, packing, quality, simhash
from rota.llm.queries import VOCABULARY
from rota.session import checkpoint_dir
from rota.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.drop_low_quality(docs, read_table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component one document stays (4-word shingles, 4 bits)."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by labels; every document stays."""
    return credentials.redact_secrets(docs, chars_col="n_chars")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens with their place in a training sequence."""
    return packing.pack(packing.token_pieces(docs, VOCABULARY))


STAGES = [
    ("quality_classifier", quality_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("secret_scan", secrets_stage),
    ("best_fit_packing", packing_stage),
]

# The classifier, fingerprints and tokens are beyond SQL: tests compare the
# stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``. Results of the stages
    before it are written to the shared checkpoint folder and read again; each is
    deleted when the next one is written. The last of them is read by the
    returned rows and stays: one folder ``corpus-pipeline-*`` a run, the caller's to
    remove."""
    docs = read_table(spark, sf_dir, "documents")
    folder, before = f"{checkpoint_dir(spark)}/corpus-pipeline-{uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        here = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(here)
        if before:
            _delete(spark, before)
        docs, before = spark.read.parquet(here), here
    return STAGES[-1][1](spark, docs, sf_dir)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
