"""Readers and sinks."""

import pytest
from pyspark.errors import AnalysisException

from rota.sources import write_documents
from rota.sources.tables import read_table


def test_appended_rows_are_seen(spark, tmp_path):
    path = str(tmp_path / "region.parquet")
    spark.range(5).write.parquet(path)
    assert read_table(spark, str(tmp_path), "region").count() == 5
    spark.range(7).write.mode("append").parquet(path)
    assert read_table(spark, str(tmp_path), "region").count() == 12


def test_documents_are_not_overwritten_by_default(spark, tmp_path):
    path = str(tmp_path / "out")
    write_documents(spark.range(2), path)
    with pytest.raises(AnalysisException):
        write_documents(spark.range(3), path)
    assert spark.read.parquet(path).count() == 2
