"""Sinks for report output at scale: write, do not collect."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_documents(df: DataFrame, path: str, fmt: str = "parquet",
                    mode: str = "errorifexists", partitions: int | None = None) -> None:
    """Write one document per owner row. ``fmt`` is any DataFrameWriter format
    (``parquet``, ``json``, ``orc``); ``partitions`` optionally sets the file count."""
    out = df.repartition(partitions) if partitions else df
    out.write.mode(mode).format(fmt).save(path)
