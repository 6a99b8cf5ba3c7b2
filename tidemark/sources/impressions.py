"""Reading impression logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _with_position(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.row_index").alias("src_row"),
    )


def read_impressions(
    spark: SparkSession, path: str, with_position: bool = False
) -> DataFrame:
    """A directory of ``*.parquet`` files, or one file.

    With ``with_position`` each row carries ``src_file`` and ``src_row``, its place in
    scan order (files by name, rows as stored), wherever it is processed.
    """
    try:
        df = spark.read.option("pathGlobFilter", "*.parquet").parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        raise FileNotFoundError(f"no Parquet files in {path}") from e
    return _with_position(df) if with_position else df


def union_files(
    spark: SparkSession,
    paths: Sequence[str],
    with_position: bool = False,
) -> DataFrame:
    """Many files as one relation; a column absent from a file is null in its rows."""
    if not paths:
        raise FileNotFoundError("no files given")
    df = spark.read.option("mergeSchema", "true").parquet(*paths)
    return _with_position(df) if with_position else df


def project_scan(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named columns; the scan reads nothing else."""
    return df.select(*columns)
