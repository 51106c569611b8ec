"""Taking in report files as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.operators.cases import flatten_reports, without_withdrawn
from casewright.sources.reports import XML_FILES, stream_reports


def ingest_cases(spark: SparkSession, root: str, deleted: DataFrame, out: str, checkpoint: str, files: str = XML_FILES, mode: str = "FAILFAST", file_name=None) -> None:
    """Flatten what is new below root and append it to out, each file once.

    Stateless; fourth quarters keep split q4_pending until they are split as a whole in batch. deleted is read when the stream starts:
    reports that were appended before their withdrawal came in stay.
    file_name: a column for source_file, if not the file's own name."""
    reports = stream_reports(spark, root, files, mode)
    if file_name is not None:
        reports = reports.withColumn("source_file", file_name)
    kept = without_withdrawn(reports, deleted, F.col("report.safetyreportid"))
    query = flatten_reports(kept).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
