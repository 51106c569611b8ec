"""Writing cases, reports of results, models, and reports as XML."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_cases(cases: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Cases by quarter; quarters in cases replace those stored before, others stay."""
    # one file a quarter where it is small, several where it is large
    writer = cases.hint("rebalance", "quarter").write.partitionBy("quarter").mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt)
    (writer.option("header", "true") if fmt == "csv" else writer).save(path)


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def write_csv(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("header", "true").csv(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _xml() -> Column:
    return F.to_xml("report", {"rowTag": "safetyreport", "indent": ""})


def xml_lengths(reports: DataFrame) -> DataFrame:
    """quarter, source_file and bytes: what write_reports_xml writes for each source file, a line's end after each report, before any packing."""
    size = F.octet_length(_xml()) + 1
    return reports.groupBy("quarter", "source_file").agg(F.sum(size).alias("bytes"))


def write_reports_xml(reports: DataFrame, path: str, compression: str | None = None, where_they_lie: bool = False) -> None:
    """(quarter, source_file, report) rows as XML below <path>/drop=<quarter>/file=<source_file>.

    One file each where they are small, several where they are large, however many tasks there were; with where_they_lie each task
    writes its own rows, and none is shuffled. Reports become text only where they are written."""
    rows = reports.select(F.lower("quarter").alias("drop"), F.col("source_file").alias("file"), "report")
    rows = rows if where_they_lie else rows.hint("rebalance", "drop", "file")
    # sorted as the writer wants them, but before they are text
    texts = rows.sortWithinPartitions("drop", "file").select("drop", "file", _xml().alias("value"))
    texts.write.partitionBy("drop", "file").text(path, compression=compression)
