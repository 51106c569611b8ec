"""Tables of this folder's operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.sources.shared import materialise, shared_dir

__all__ = ["materialise", "read_table", "shared_dir", "small_batches", "whole_rows"]

#: Rows of a batch that goes to Python, at most: 4 MB of texts of 2 kB.
BATCH_ROWS = 2_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_rows(docs: DataFrame, *columns) -> DataFrame:
    """docs as one column `row`, next to columns: names inside a row clash with nothing. select("row.*") gives docs back."""
    return docs.select(F.struct("*").alias("row"), *columns)


def small_batches(spark: SparkSession) -> None:
    """From here on no batch that this session sends to Python has more than BATCH_ROWS rows: the JVM and Python both hold it, some times over."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, str(BATCH_ROWS))
