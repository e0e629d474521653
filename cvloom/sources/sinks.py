"""Writers of result records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cvloom.plans.pipeline import RECORD, record_json


def write_json(records: DataFrame, folder: str) -> None:
    """One JSON object per line with all eight keys, null ones included, in ASCII; `api.to_json` indents a single record."""
    records.select(record_json(RECORD, ascii_only=True).alias("value")).write.mode("overwrite").text(folder)


def write_parquet(records: DataFrame, folder: str) -> None:
    records.write.mode("overwrite").parquet(folder)


def split_errors(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that were read, rows with an error)."""
    return records.where(F.col("error").isNull()), records.where(F.col("error").isNotNull())
