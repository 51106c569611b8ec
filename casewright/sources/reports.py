"""Reading quarterly drops of XML reports and their delete lists.

A drop is a folder right below the data folder, with its quarter (like 2025q1) in its own name, reports in XML/*.xml and withdrawn ids in
Deleted/DELETE*.txt. The folders are listed first, and every reader takes its files from them: folders without a quarter are
passed over, names further up or down the path do not count, and a data folder without any drop is an error.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import scalars as S
from casewright.functions.schema import REPORT_FIELDS

#: Files of a drop, below its folder.
XML_FILES = "XML/*.xml"
DELETE_FILES = "Deleted/DELETE*.txt"
END_TAG = "</safetyreport>"
_QUARTER = r"(?i)((?:19|20)\d{2})q([1-4])"


@dataclass(frozen=True)
class Drops:
    """The data folder's path, as it stands in file paths, and its drops: (folder, quarter), by name."""

    spark: SparkSession
    path: str
    folders: tuple[tuple[str, str], ...]

    def quarter_of(self, path: Column) -> Column:
        return quarter_below(self.path, path)

    def files(self, pattern: str) -> list[str]:
        """The folders' patterns that some file fits."""
        jvm = self.spark.sparkContext._jvm
        fits = [jvm.org.apache.hadoop.fs.Path(f"{folder}/{pattern}") for folder, _ in self.folders]
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        return [p.toString() for p in fits if p.getFileSystem(conf).globStatus(p)]

    def quarters(self) -> DataFrame:
        """quarter, one row each, those without files too."""
        return self.spark.createDataFrame([(q,) for q in sorted({q for _, q in self.folders})], "quarter string")


def _place(spark: SparkSession, root: str):
    """The file system and the full path of a folder."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store, store.makeQualified(place)


def find_drops(spark: SparkSession, root: str) -> Drops:
    store, place = _place(spark, root)
    found = []
    for entry in store.listStatus(place) if store.exists(place) else []:
        name = re.search(_QUARTER, entry.getPath().getName())
        if entry.isDirectory() and name:
            found.append((entry.getPath().toString(), f"{name[1]}Q{name[2]}"))
    if not found:
        raise FileNotFoundError(f"no folder below {root} has a quarter like 2025q1 in its name")
    return Drops(spark, place.toUri().getRawPath(), tuple(sorted(found)))


def quarter_below(root_path: str, path: Column) -> Column:
    """YYYYQn from the name of the folder right below root_path on a path; "" if there is none."""
    child = F.regexp_extract(path, re.escape(root_path.rstrip("/")) + "/([^/]+)/", 1)
    year, number = F.regexp_extract(child, _QUARTER, 1), F.regexp_extract(child, _QUARTER, 2)
    return F.when(number != "", F.concat(year, F.lit("Q"), number)).otherwise("")


def _text(drops: Drops, files: str, end: str | None = None) -> DataFrame:
    """Lines of the drops' files, or text split at `end`. No file at all is an error."""
    paths = drops.files(files)
    if not paths:
        raise FileNotFoundError(f"no {files} in any drop below {drops.path}")
    reader = drops.spark.read
    return (reader.option("lineSep", end) if end else reader).text(paths)


#: Order of the document: files by path, parts of a file as they lie, reports as they come.
DOCUMENT_ORDER = ("file_path", "block", "place")


def report_chunks(lines: DataFrame, root_path: str, *more: str) -> DataFrame:
    """quarter, source_file, file_path and the XML of one report from text split at END_TAG; other text is dropped."""
    value, bare = F.col("value"), F.ltrim("value", F.lit(S.BLANKS))
    # most texts begin with their tag, and no pattern need look for it
    at_once = F.startswith(bare, F.lit("<safetyreport>"))
    body = F.when(at_once, bare).otherwise(F.regexp_extract(value, r"(?s)<safetyreport[\s>].*", 0))
    found = lines.where(at_once | value.rlike(r"<safetyreport[\s>]"))
    return found.select(quarter_below(root_path, F.col("_metadata.file_path")).alias("quarter"), F.col("_metadata.file_name").alias("source_file"), F.col("_metadata.file_path").alias("file_path"), *more, F.concat(body, F.lit(END_TAG)).alias("xml"))


def parsed_reports(chunks: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """chunks with the report as a struct. PERMISSIVE gives nulls for what cannot be read; FAILFAST stops."""
    options = {"rowTag": "safetyreport", "ignoreNamespace": "true", "mode": mode}
    return chunks.withColumn("report", F.from_xml("xml", REPORT_FIELDS, options)).drop("xml")


def read_reports(spark: SparkSession, root: str, files: str = XML_FILES, mode: str = "FAILFAST") -> DataFrame:
    """All reports of the drops below root, one row each, with DOCUMENT_ORDER: a report's file, where its part of the file begins, and
    its place there. Files are split between tags, so a large file is many tasks' work.

    For UTF-8 files with plain <safetyreport> tags; read_whole_reports takes any."""
    drops = find_drops(spark, root)
    lines = _text(drops, files, END_TAG)
    placed = lines.select("value", "_metadata", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))
    return parsed_reports(report_chunks(placed, drops.path, "block", "place"), mode)


def stream_reports(spark: SparkSession, root: str, files: str = XML_FILES, mode: str = "FAILFAST") -> DataFrame:
    """The same rows, without block and place, from files as they land, in drops that are there or come later."""
    _, place = _place(spark, root)
    lines = spark.readStream.option("lineSep", END_TAG).text(f"{root}/*/{files}")
    return parsed_reports(report_chunks(lines, place.toUri().getRawPath()).where("quarter <> ''"), mode)


def read_whole_reports(spark: SparkSession, root: str, files: str = XML_FILES, mode: str = "FAILFAST") -> DataFrame:
    """Reports with prefixed tags, other encodings or end tags inside comments: each file is read by one task."""
    drops = find_drops(spark, root)
    rows = spark.read.format("xml").options(rowTag="safetyreport", ignoreNamespace="true", mode=mode).schema(REPORT_FIELDS).load(drops.files(files))
    path = F.col("_metadata.file_path")
    fields = [c for c in rows.columns]
    return rows.select(drops.quarter_of(path).alias("quarter"), F.col("_metadata.file_name").alias("source_file"), path.alias("file_path"), F.struct(*fields).alias("report"))


def read_deleted_ids(spark: SparkSession, root: str, files: str = DELETE_FILES) -> DataFrame:
    """Distinct (quarter, safetyreportid) of the first delete list of each drop; drops of one quarter are united. None need have a list."""
    drops = find_drops(spark, root)
    if not drops.files(files):
        return spark.createDataFrame([], "quarter string, safetyreportid string")
    path = F.col("_metadata.file_path")
    lines = _text(drops, files).select(path.alias("path"), S.strip(F.col("value")).alias("safetyreportid"))
    lines = lines.withColumn("folder", F.regexp_replace("path", "/[^/]*$", ""))
    first = lines.groupBy("folder").agg(F.min("path").alias("path"))
    listed = lines.where("safetyreportid <> ''").join(first, ["folder", "path"], "left_semi")
    return listed.select(drops.quarter_of(F.col("path")).alias("quarter"), "safetyreportid").distinct()


def list_files(spark: SparkSession, root: str, files: str = XML_FILES) -> DataFrame:
    """quarter, source_file, path and bytes of every file of the drops; no content is read."""
    drops = find_drops(spark, root)
    paths = drops.files(files)
    if not paths:
        return spark.createDataFrame([], "quarter string, source_file string, path string, bytes long")
    rows = spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("bytes"))
    return rows.select(drops.quarter_of(F.col("path")).alias("quarter"), F.element_at(F.split("path", "/"), -1).alias("source_file"), "path", "bytes")


def list_quarters(spark: SparkSession, root: str, files: str = XML_FILES, name: Column | None = None) -> DataFrame:
    """Files and bytes of every quarter that has a drop; a drop may be without files.

    name: a column of list_files that parts of one file have in common, where files are stored in parts."""
    number = F.count("*") if name is None else F.count_distinct(name)
    counts = list_files(spark, root, files).groupBy("quarter").agg(number.alias("xml_files"), F.sum("bytes").alias("bytes"))
    return find_drops(spark, root).quarters().join(counts, "quarter", "left").fillna(0, ["xml_files", "bytes"])


def count_reports(spark: SparkSession, root: str, files: str = XML_FILES) -> DataFrame:
    """Reports in each file before any is dropped: literal opening tags are counted, nothing is parsed."""
    drops = find_drops(spark, root)
    path = F.col("_metadata.file_path")
    tags = F.regexp_count("value", F.lit("<safetyreport>"))
    return _text(drops, files, END_TAG).select(drops.quarter_of(path).alias("quarter"), F.col("_metadata.file_name").alias("source_file"), path.alias("path"), tags.alias("n")).groupBy("quarter", "source_file", "path").agg(F.sum("n").alias("reports"))


def inventory(spark: SparkSession, root: str, files: str = XML_FILES, deleted: DataFrame | None = None, name: Column | None = None) -> DataFrame:
    """Files, bytes, reports and withdrawn ids by quarter, and in all (quarter null). name: as in list_quarters."""
    sizes = list_quarters(spark, root, files, name)
    counts = count_reports(spark, root, files).groupBy("quarter").agg(F.sum("reports").alias("reports"))
    gone = (deleted if deleted is not None else read_deleted_ids(spark, root)).groupBy("quarter").agg(F.count("*").alias("deleted_ids"))
    joined = sizes.join(counts, "quarter", "left").join(gone, "quarter", "left").fillna(0, ["reports", "deleted_ids"])
    return joined.rollup("quarter").agg(*[F.sum(c).alias(c) for c in ("xml_files", "bytes", "reports", "deleted_ids")])


def read_cases(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Stored cases, all or of one split; the filter reaches the files."""
    cases = spark.read.parquet(path)
    return cases if split is None else cases.where(F.col("split") == split)
