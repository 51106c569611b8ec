from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from casewright.functions.schema import CASE_COLUMNS
from casewright.operators.metrics import all_metrics
from casewright.operators import cases, metrics, splits
from casewright.plans import jobs, queries
from casewright.sources import reports as R
from casewright.sources import sinks
from casewright.streaming.ingest import ingest_cases


def report(i: str, day: str = "20251001", text: str = "x") -> str:
    return f"<safetyreport><safetyreportid>{i}</safetyreportid><receivedate>{day}</receivedate><primarysourcecountry>{text}</primarysourcecountry></safetyreport>\n"


def write(folder, name: str, reports: list[str], deleted: str | None = None):
    (folder / "XML").mkdir(parents=True, exist_ok=True)
    (folder / "XML" / name).write_text("<root>\n" + "".join(reports) + "</root>\n")
    if deleted is not None:
        (folder / "Deleted").mkdir(exist_ok=True)
        (folder / "Deleted" / "DELETE1.txt").write_text(deleted)


def test_quarter_is_that_of_the_folder_below_the_root(spark, tmp_path):
    root = tmp_path / "2024q1_archive" / "data"
    write(root / "reports_xml_2025Q2", "2019q3.xml", [report("1"), report("2")], "2\n")
    write(root / "reports_xml_2025q4" / "2023q1", "inner.xml", [report("9")])
    write(root / "notes", "a.xml", [report("3")], "3\n")
    (root / "empty_2025q3").mkdir()
    (root / "2025q1.txt").write_text("no folder")
    at = f"file://{root}"
    assert {(r.quarter, r.report.safetyreportid) for r in R.read_reports(spark, at).collect()} == {("2025Q2", "1"), ("2025Q2", "2")}
    assert {(r.quarter, r.report.safetyreportid) for r in R.read_whole_reports(spark, at).collect()} == {("2025Q2", "1"), ("2025Q2", "2")}
    assert [tuple(r) for r in R.read_deleted_ids(spark, at).collect()] == [("2025Q2", "2")]
    assert [r.quarter for r in R.list_files(spark, at).collect()] == ["2025Q2"]
    assert {(r.quarter, r.xml_files) for r in R.list_quarters(spark, at).collect()} == {("2025Q2", 1), ("2025Q3", 0), ("2025Q4", 0)}
    assert {(r.quarter, r.reports, r.deleted_ids) for r in R.inventory(spark, at).collect()} == {("2025Q2", 2, 1), ("2025Q3", 0, 0), ("2025Q4", 0, 0), (None, 2, 1)}
    out = tmp_path / "out"
    ingest_cases(spark, at, R.read_deleted_ids(spark, at), f"file://{out}/cases", f"file://{out}/checkpoint")
    assert [(r.quarter, r.safetyreportid) for r in spark.read.parquet(f"file://{out}/cases").collect()] == [("2025Q2", "1")]
    stored = jobs.run_etl(spark, at, f"file://{out}/etl")
    assert [(r.quarter, r.safetyreportid) for r in stored.collect()] == [("2025Q2", "1")]
    log = {r.quarter: (r.xml_files, r.parsed, r.kept, r.deleted_skipped) for r in spark.read.json(f"file://{out}/etl/interim/parse_log").collect()}
    assert log == {"2025Q2": (1, 2, 1, 1), "2025Q3": (0, 0, 0, 0), "2025Q4": (0, 0, 0, 0)}


@pytest.mark.parametrize("reader", [R.read_reports, R.read_whole_reports, R.read_deleted_ids, R.list_files, R.list_quarters, R.count_reports, R.inventory])
def test_no_drop_is_an_error(spark, tmp_path, reader):
    write(tmp_path / "notes", "a.xml", [report("3")])
    with pytest.raises(FileNotFoundError, match="quarter"):
        reader(spark, f"file://{tmp_path}")


def test_drops_without_a_list_or_with_odd_names(spark, tmp_path):
    write(tmp_path / "a b (2025q1)", "x y.xml", [report("1")])
    at = f"file://{tmp_path}"
    assert R.read_deleted_ids(spark, at).count() == 0
    assert [(r.quarter, r.report.safetyreportid) for r in R.read_reports(spark, at).collect()] == [("2025Q1", "1")]


def expected_split(rows: list[tuple[str, str, str]]) -> dict[str, str]:
    """Stable sort of (id, day, name) in document order by day and id, then half and half."""

    def key(row):
        i, day, _ = row
        return (day if day.isdigit() else "99999999", 0 if i.isdigit() else 1, int(i) if i.isdigit() else 0, "" if i.isdigit() else i)

    ordered = sorted(rows, key=key)
    return {name: "valid" if k < len(rows) // 2 else "test" for k, (_, _, name) in enumerate(ordered)}


@pytest.mark.parametrize("ids", [[""], ["7", "007"], ["", "5", "x1", "12"]])
def test_ties_of_the_split_go_in_document_order(spark, tmp_path, ids):
    rng, rows = random.Random(1), []
    for f in range(3):
        part = [(rng.choice(ids), rng.choice(["20251001", "20251001", "bad"]), f"N{f}_{i:03}") for i in range(67)]
        write(tmp_path / "xml_2025q4", f"f{f}.xml", [report(i, day, name) for i, day, name in part])
        rows += part
    want = expected_split(rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, partitions in (("128m", "4"), ("700b", "7"), ("3k", "1")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            stored = jobs.run_etl(spark, f"file://{tmp_path}", f"file://{tmp_path}/out-{size}")
            assert {r.primarysourcecountry: r.split for r in stored.collect()} == want
            assert set(stored.columns) == set(CASE_COLUMNS)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_plain_split_takes_the_same_order(spark, tmp_path):
    rows = [("", "20251001", f"N{i:02}") for i in range(10)]
    write(tmp_path / "xml_2025q4", "f.xml", [report(*r) for r in rows])
    placed = cases.flatten_reports(R.read_reports(spark, f"file://{tmp_path}"), *R.DOCUMENT_ORDER).repartition(5)
    for form in (splits.split_by_rank, splits.split_by_time):
        assert {r.primarysourcecountry for r in form(placed).where("split = 'valid'").collect()} == {f"N{i:02}" for i in range(5)}


def test_bytes_listed_are_bytes_written(spark, sf_dir):
    path = queries.xml_drop(spark, sf_dir)
    written = {(r.quarter, r.source_file): r.bytes for r in sinks.xml_lengths(queries.nested(spark, sf_dir)).collect()}
    listed = R.list_files(spark, path, queries.XML_LAYOUT).withColumn("file", F.regexp_extract("path", "file=([^/]+)/", 1))
    assert {(r.quarter, r.file): r.n for r in listed.groupBy("quarter", "file").agg(F.sum("bytes").alias("n")).collect()} == written


def plan_exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_all_metrics_come_from_one_table(spark, sf_dir):
    scores = queries.testbed.scores(spark, sf_dir).where(F.col("split").isin("valid", "test"))
    assert plan_exchanges(metrics.stratum_metrics(scores, ["model", "split"], 0.5)) <= 20


def test_all_metrics_equal_those_one_by_one(spark):
    rows = [("m" if i % 3 else None, str(i), int(i * 7 % 5 < 2), None if i % 11 == 0 else (i * 37 % 20) / 20) for i in range(300)]
    df = spark.createDataFrame(rows, "model string, safetyreportid string, label int, score double").repartition(3)
    both = {r.model: r for r in all_metrics(df, ["model"], F.lit(0.4)).collect()}
    assert set(both) == {"m", None}
    for r in metrics.confusion(df, ["model"], F.lit(0.4)).collect():
        assert all(both[r.model][c] == pytest.approx(r[c]) for c in ("n", "positives", "positive_rate", "threshold", "precision", "recall", "f1"))
    for r in metrics.ranking_metrics(df, ["model"]).collect():
        assert all(both[r.model][c] == pytest.approx(r[c]) for c in ("auroc", "average_precision"))
    for r in metrics.top_metrics(df, ["model"]).collect():
        assert both[r.model][f"recall_top{r.percent}"] == pytest.approx(r.recall) and both[r.model][f"hit_rate_top{r.percent}"] == pytest.approx(r.hit_rate)


def test_packed_reports_take_little_room(spark, sf_dir):
    given = sum((Path(sf_dir) / f"{t}.parquet").stat().st_size for t in ("orders", "lineitem", "customer", "part", "nation"))
    stored = queries.src_file_inventory(spark, sf_dir)
    assert stored.agg(F.sum("bytes")).first()[0] < 4 * given
    names = queries.agg_file_reports(spark, sf_dir).select("quarter", "source_file").distinct().count()
    assert stored.count() == names


def test_parts_of_a_file_are_one_file(spark, sf_dir):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = R.list_files(spark, queries.packed_drop(spark, sf_dir), queries.XML_LAYOUT).count()
        files, counted = queries.src_file_inventory(spark, sf_dir).collect(), queries.agg_inventory(spark, sf_dir).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert parts > len(files) == len({(r.quarter, r.source_file) for r in files})
    assert {r.quarter: r.xml_files for r in counted} == {None: len(files)} | {q: sum(r.quarter == q for r in files) for q in {r.quarter for r in files}}


def test_reports_are_not_shuffled_as_text(spark, sf_dir, monkeypatch):
    plans = []
    monkeypatch.setattr(DataFrameWriter, "text", lambda writer, *_, **__: plans.append(writer._df._jdf.queryExecution().executedPlan().toString()))
    for where_they_lie in (False, True):
        sinks.write_reports_xml(queries.nested(spark, sf_dir), "unused", "gzip", where_they_lie)
        (plan,), plans = [plans.pop()], plans
        # the text is made above the last exchange, and the last exchange of rows that stay is that of the given tables
        assert "to_xml" in plan[: plan.index("Exchange")]
        assert where_they_lie is ("REBALANCE_PARTITIONS" not in plan)
        assert all("to_xml" not in line and "medicinalproduct" not in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_tags_at_odd_places(spark, tmp_path):
    inner = "<safetyreportid>{}</safetyreportid></safetyreport>"
    text = f"<root><safetyreport>{inner.format(1)}\n \t<safetyreport>{inner.format(2)}x<safetyreport a='1'>{inner.format(3)}<safetyreport\n>{inner.format(4)}<safetyreports>{inner.format(5)}</root>"
    (tmp_path / "2025q1" / "XML").mkdir(parents=True)
    (tmp_path / "2025q1" / "XML" / "a.xml").write_text(text)
    assert [r.report.safetyreportid for r in R.read_reports(spark, f"file://{tmp_path}").collect()] == ["1", "2", "3", "4"]
