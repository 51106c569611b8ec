from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions.schema import CASE_COLUMNS
from casewright.functions.scalars import LEAKAGE_FIELDS
from casewright.operators import cases, features, splits
from casewright.plans import testbed
from casewright.sources import reports as R
from tests.compare import spark_rows


def test_nested_and_table_forms_agree(spark, sf_dir):
    h, d, r = testbed.headers(spark, sf_dir), testbed.drugs(spark, sf_dir), testbed.reactions(spark, sf_dir)
    table = cases.cases_from_tables(h, d, r, "k").select(*CASE_COLUMNS)
    assert spark_rows(cases.flatten_reports(cases.nested_reports(h, d, r, "k"))) == spark_rows(table)


def test_no_leakage(spark, sf_dir):
    rows = features.feature_view(cases.cases_from_tables(testbed.headers(spark, sf_dir), testbed.drugs(spark, sf_dir), testbed.reactions(spark, sf_dir), "k"))
    assert not set(rows.columns) & set(LEAKAGE_FIELDS)
    assert rows.where(features.hash_text().contains("serious")).count() == 0
    assert not set(features.NUMERIC_FEATURES) & set(LEAKAGE_FIELDS)


XML = """<?xml version="1.0" encoding="UTF-8"?>
<ichicsr lang="en"><head>x</head>
<safetyreport><safetyreportid>007</safetyreportid><serious>1</serious><receivedate>20251001</receivedate>
<primarysource><reportercountry>US</reportercountry></primarysource><primarysource><reportercountry>FR</reportercountry></primarysource>
<patient><patientonsetage>24</patientonsetage><patientonsetageunit>802</patientonsetageunit>
<drug><medicinalproduct>A &amp; B</medicinalproduct><drugcharacterization>1</drugcharacterization><drugindication>--</drugindication>
<activesubstance><activesubstancename> </activesubstancename></activesubstance><activesubstance><activesubstancename>beta</activesubstancename></activesubstance></drug>
<reaction><reactionmeddrapt>Headache</reactionmeddrapt></reaction></patient></safetyreport>
<safetyreport version="1"><safetyreportid>123</safetyreportid></safetyreport>
<safetyreport><patient/></safetyreport>
</ichicsr>
"""


def drop(tmp_path):
    folder = tmp_path / "data" / "reports_xml_2025q4"
    (folder / "XML").mkdir(parents=True)
    (folder / "Deleted").mkdir()
    (folder / "XML" / "one.xml").write_text(XML)
    (folder / "Deleted" / "DELETE1.txt").write_text("\n123\n\n 456 \n123\n")
    (folder / "Deleted" / "DELETE2.txt").write_text("007\n")
    return f"file://{tmp_path}/data"


def test_reading_reports(spark, tmp_path):
    root = drop(tmp_path)
    found = {r.safetyreportid: r for r in cases.flatten_reports(R.read_reports(spark, root)).collect()}
    assert set(found) == {"007", "123", ""}
    row = found["007"]
    assert (row.quarter, row.source_file, row.reportercountry, row.age_years, row.label_serious) == ("2025Q4", "one.xml", "US", 2.0, 1)
    assert (row.drug_count, row.active_substance_count, row.canonical_drug_count, row.indication_count) == (1, 1, 1, 1)
    assert row.text_tokens == "drug:BETA drugchar:1 reac:HEADACHE"
    assert found["123"].drug_count == 0 and found["123"].text_tokens == "" and found["123"].has_drug_start == 0
    whole = cases.flatten_reports(R.read_whole_reports(spark, root))
    assert spark_rows(whole) == spark_rows(cases.flatten_reports(R.read_reports(spark, root)))


def test_delete_list(spark, tmp_path):
    root = drop(tmp_path)
    ids = R.read_deleted_ids(spark, root)
    assert {tuple(r) for r in ids.collect()} == {("2025Q4", "123"), ("2025Q4", "456")}
    kept = cases.without_withdrawn(R.read_reports(spark, root), ids, F.col("report.safetyreportid"))
    assert {r.report.safetyreportid for r in kept.collect()} == {"007", None}


def test_inventory(spark, tmp_path):
    rows = {r.quarter: r for r in R.inventory(spark, drop(tmp_path)).collect()}
    assert (rows["2025Q4"].xml_files, rows["2025Q4"].reports, rows["2025Q4"].deleted_ids) == (1, 2, 2)  # the tag with an attribute is no literal match
    assert rows[None].bytes == rows["2025Q4"].bytes == len(XML.encode())


def test_time_split(spark):
    schema = "quarter string, receivedate string, safetyreportid string"
    rows = [("2025Q4", "20251004", "4"), ("2025Q4", "20251001", "1"), ("2025Q4", "20251003", "3"), ("2025Q4", "20251002", "2"), ("2025Q1", "20250101", "5")]
    ties = [("2024Q4", "bad", "1"), ("2024Q4", "20251001", "20"), ("2024Q4", "20251001", "10"), ("2024Q4", "", "2")]
    df = spark.createDataFrame(rows + ties + [("2023Q4", "", str(i)) for i in range(3)] + [("2022Q4", "20221001", "1")], schema)
    for form in (splits.split_by_rank, splits.split_by_time):
        got = {(r.quarter, r.safetyreportid): r.split for r in form(df).collect()}
        assert [got["2025Q4", i] for i in "4132"] == ["test", "valid", "test", "valid"]
        assert [got["2024Q4", i] for i in ("1", "20", "10", "2")] == ["test", "valid", "valid", "test"]
        assert [got["2023Q4", i] for i in "012"] == ["valid", "test", "test"]
        assert got["2022Q4", "1"] == "test" and got["2025Q1", "5"] == "train"


def test_time_split_where_most_days_are_missing(spark):
    """Half of a quarter and more has no date, ids repeat and are null: the same numbers of rows as by ranking all."""
    ids = F.when(F.col("id") % 7 == 0, F.lit(None)).when(F.col("id") % 7 < 4, F.lit("5")).otherwise((F.col("id") * 37 % 900).cast("string"))
    day = F.when(F.col("id") % 5 == 0, F.lit("20251103")).otherwise(F.lit("bad"))
    df = spark.range(0, 2001, 1, 6).select("id", F.lit("2025Q4").alias("quarter"), day.alias("receivedate"), ids.alias("safetyreportid"))
    counts = [{tuple(map(str, r)): r["n"] for r in form(df).groupBy("receivedate", "safetyreportid", "split").agg(F.count("*").alias("n")).collect()} for form in (splits.split_by_rank, splits.split_by_time)]
    assert counts[0] == counts[1]
    placed = df.withColumn("position", F.col("id"))
    plain, dealt = [{r.id: r.split for r in form(placed).collect()} for form in (splits.split_by_rank, splits.split_by_time)]
    assert plain == dealt and len(plain) == 2001 and sum(v == "valid" for v in plain.values()) == 1000


def test_capped_sample_is_the_least_hashes(spark):
    df = spark.range(5000).selectExpr("cast(id as string) as i")
    small = {r.i for r in splits.capped_sample(df, 50, F.col("i")).collect()}
    plain = {r.i for r in df.orderBy(F.md5(F.concat(F.lit("42:"), "i"))).limit(50).collect()}
    assert small == plain and splits.capped_sample(df, 10_000, F.col("i")).count() == 5000


def test_capped_sample_of_repeated_keys(spark):
    df = spark.range(20_000).selectExpr("CASE WHEN id % 10 < 7 THEN '' ELSE cast(id as string) END AS i", "id")
    drawn = splits.capped_sample(df, 300, F.col("i"))
    assert drawn.count() == 300
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, splits.capped_sample(df.repartition(5), 300, F.col("i")).collect()))


def test_delete_lists_of_every_folder(spark, tmp_path):
    for folder, lists in (("a_2025q1", {"DELETE2.txt": "11\n", "DELETE1.txt": "12\n"}), ("b_2025q1", {"DELETE9.txt": "22\n"}), ("c_2025Q2", {"DELETE.txt": "22\n"})):
        (tmp_path / folder / "Deleted").mkdir(parents=True)
        for name, text in lists.items():
            (tmp_path / folder / "Deleted" / name).write_text(text)
    assert {tuple(r) for r in R.read_deleted_ids(spark, f"file://{tmp_path}").collect()} == {("2025Q1", "12"), ("2025Q1", "22"), ("2025Q2", "22")}


def test_reports_in_document_order(spark, tmp_path):
    root = drop(tmp_path)
    rows = R.read_reports(spark, root).orderBy(*R.DOCUMENT_ORDER).collect()
    assert [r.report.safetyreportid for r in rows] == ["007", "123", None]


def test_a_shared_folder_is_asked_for_off_local_masters(monkeypatch):
    import pytest

    from casewright.sources import shared

    class Away:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master, applicationId = "spark://host:7077", "x"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Away)


def test_sweep_deletes_what_was_written(spark, monkeypatch):
    from casewright.sources import shared

    monkeypatch.setattr(shared, "_TABLES", {})
    table = shared.materialise(spark.range(3), "swept")
    (path,) = shared._TABLES[spark.sparkContext.applicationId]
    assert table.count() == 3 and shared.sweep(spark) == 1
    import os

    assert not os.path.exists(path.removeprefix("file://"))
