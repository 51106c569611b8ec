from __future__ import annotations

import pytest

import __spark_entry__ as entry
from casewright.plans import queries
from casewright.plans.jobs import Options, run_etl, run_inventory, run_report, run_train
from tests.compare import spark_rows, sql_rows
from tests.test_cases import drop

#: Checked at the smallest size here; the others share their code, and all are compared at sf0.01 each round.
CHECKED = [
    "src_reports_xml",
    "snk_cases",
    "src_deleted_ids",
    "prj_case_header",
    "fn_age_years",
    "fn_round6",
    "fn_parse_date",
    "fn_make_token",
    "snk_reports",
    "snk_model",
    "agg_inventory",
    "agg_file_reports",
    "agg_parse_log",
    "agg_label_rates",
    "agg_missingness",
    "agg_weak_rules",
    "agg_weak_consensus",
    "agg_class_weights",
    "agg_token_counts",
    "fn_parse_float",
    "fn_canonical_drug",
    "arr_text_tokens",
    "win_time_split",
    "flt_split",
    "ftr_hashed_vector",
    "mdl_score_from_table",
    "src_quarters",
    "smp_train_cap",
    "top_recall_at_pct",
    "join_threshold_candidates",
    "met_strata",
    "met_split_table",
    "stm_ingest_cases",
]


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    names, rows = sql_rows(queries.ORACLE[name], sf_dir)
    assert sorted(df.columns) == names
    assert spark_rows(df) == rows


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_no_case_query_falls_back_from_compiled_code(spark, sf_dir, capfd):
    for name in ("prj_case_header", "join_case_children", "agg_label_rates", "agg_token_counts", "win_time_split", "arr_text_tokens"):
        queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    out, err = capfd.readouterr()
    assert "64 KB" not in out + err and "Failed to compile" not in out + err


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_jobs(spark, tmp_path):
    root, out = drop(tmp_path), f"file://{tmp_path}/out"
    assert run_inventory(spark, root, out).count() == 2
    cases = run_etl(spark, root, out)
    assert {(r.safetyreportid, r.split) for r in cases.collect()} == {("007", "valid"), ("", "test")}
    (log,) = spark.read.json(f"{out}/interim/parse_log").collect()
    assert (log.parsed, log.kept, log.deleted_skipped, log.missing_id, log.train_cases, log.valid_cases, log.test_cases) == (3, 2, 1, 1, 0, 1, 1)
    run_etl(spark, root, f"{out}2", Options(sample=1))
    (log,) = spark.read.json(f"{out}2/interim/parse_log").collect()
    assert (log.parsed, log.kept, log.test_cases) == (1, 1, 1)  # reading stops at the first report that is kept
    tables = run_report(spark, out)
    assert tables["label_rates"].count() == 4


def test_training_job(spark, sf_dir, tmp_path):
    from casewright.plans.queries import split_cases
    from casewright.sources.sinks import write_cases

    out = f"file://{tmp_path}/out"
    write_cases(split_cases(spark, sf_dir).drop("k"), f"{out}/interim/cases")
    table = run_train(spark, out, Options(n_features=1 << 10, tree_rounds=2))
    assert {(r.model, r.split) for r in table.collect()} == {(m, s) for m in ("logistic", "trees") for s in ("train", "valid", "test")}
    (config,) = spark.read.json(f"{out}/models/feature_config").collect()
    assert config.hash_n_features == 1 << 10 and "serious" in config.leakage_fields_left_out and len(config.numeric_features) == 23
    # without a valid split the threshold is the plain one, and no metrics are lost
    rest = spark.read.parquet(f"{out}/interim/cases").where("split <> 'valid'")
    write_cases(rest, f"{out}3/interim/cases")
    table = run_train(spark, f"{out}3", Options(n_features=1 << 10, tree_rounds=2))
    assert {(r.model, r.split, r.threshold) for r in table.collect()} == {(m, s, 0.5) for m in ("logistic", "trees") for s in ("train", "test")}
