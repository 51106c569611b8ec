from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from casewright.functions import scalars as S


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_age(spark):
    rows = [("24", "802"), ("365.25", "804"), ("999", "801"), ("", "801"), ("-3", "801"), ("5", "9"), ("3", "800"), (None, None), ("nan", "801")]
    assert values(spark, rows, "a string, u string", S.age_years(F.col("a"), F.col("u"))) == [2.0, 1.0, None, None, None, None, 30.0, None, None]


def test_normalise_and_token(spark):
    assert values(spark, [("  acetaminophen / codeine  ",), ("--",), (None,), ("ß-x",)], "t string", S.normalize_text(F.col("t"))) == ["ACETAMINOPHEN CODEINE", "", "", "SS X"]
    assert values(spark, [("Bimekizumab 160 mg/mL",), ("?",), ("a" * 200,)], "t string", S.make_token("drug", F.col("t"))) == ["drug:BIMEKIZUMAB_160_MG_ML", "", "drug:" + "A" * 120]


def test_label(spark):
    schema = ", ".join(f"{f} string" for f in S.SERIOUSNESS_FLAGS)
    none, hospital, serious, empty = ["2"] * 7, ["2"] * 7, ["2"] * 7, [None] * 7
    hospital[3], serious[0] = "1", " 1 "
    assert values(spark, [none, hospital, serious, empty], schema, S.label_from_flags()) == [0, 1, 1, 0]


def test_date(spark):
    rows = [("20250131",), ("20250231",), ("",), (None,), (" 20250131120000",), ("00000101",), ("2025-1-1",)]
    day = datetime.date(2025, 1, 31)
    assert values(spark, rows, "d string", S.parse_date(F.col("d"))) == [day, None, None, None, day, None, None]


def test_parse_float(spark):
    rows = ["1,234", "1,234 mg", "1e5", "-5", ".5", "kg", "", None, " 7 ", "0x1p3", "x-2.5y"]
    assert values(spark, [(r,) for r in rows], "x string", S.parse_float(F.col("x"))) == [1234.0, 1.0, 1e5, -5.0, 0.5, None, None, None, 7.0, 0.0, -2.5]


def test_round6(spark):
    rows = [25 / 12, 1000.125, 1000.375, 123456.5, -1000.125, 0.0, float("nan"), float("inf"), None, 9.9999996, 1e-20]
    assert values(spark, [(r,) for r in rows], "x double", S.round6(F.col("x"))) == [2.08333, 1000.12, 1000.38, 123456.0, -1000.12, 0.0, None, None, None, 10.0, 1e-20]


def test_bins(spark):
    assert values(spark, [(None,), (17.9,), (18.0,), (65.0,)], "x double", S.age_bin(F.col("x"))) == ["unknown", "child", "adult", "senior"]
    assert values(spark, [(None,), (0.0,), (0.5,), (1.0,), (4.0,), (9.0,), (10.0,)], "x double", S.count_bin(F.col("x"))) == ["unknown", "0", "2_4", "1", "2_4", "5_9", "10_plus"]


def test_quarter_split(spark):
    assert values(spark, [(f"2025Q{i}",) for i in (1, 2, 3, 4)], "q string", S.quarter_split(F.col("q"))) == ["train"] * 3 + ["q4_pending"]


def test_report_ids_sort_by_value_then_text(spark):
    ids = ["10", "9", "US-1", "007", "1" + "0" * 30, "", "8"]
    df = spark.createDataFrame([(i,) for i in ids], "i string")
    assert [r.i for r in df.orderBy(*S.report_id_keys(F.col("i"))).collect()] == ["007", "8", "9", "10", "1" + "0" * 30, "", "US-1"]


def test_canonical_drug(spark):
    df = spark.createDataFrame([(["-", "b c"], "x"), ([], " y "), (None, None)], "s array<string>, p string")
    assert [r[0] for r in df.select(S.canonical_drug(F.col("s"), F.col("p"))).collect()] == ["B C", "Y", ""]


@pytest.mark.parametrize(("num", "den", "expected"), [(1, 4, 25.0), (1, 0, None)])
def test_pct(spark, num, den, expected):
    assert values(spark, [(num, den)], "a int, b int", S.pct(F.col("a"), F.col("b"))) == [expected]
