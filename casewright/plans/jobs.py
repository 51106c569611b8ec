"""The jobs from drops of reports to cases, models and audit tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import scalars as S
from casewright.operators import audit, metrics, models
from casewright.operators.cases import flatten_reports, without_withdrawn
from casewright.operators.features import N_FEATURES
from casewright.operators.splits import VALID_FRACTION, first_per_quarter, split_by_time
from casewright.sources import reports as R
from casewright.sources import sinks
from casewright.sources.shared import materialise, sweep


@dataclass(frozen=True)
class Options:
    """sample: kept reports of each quarter (0: all). mode: what an unreadable report does."""

    files: str = R.XML_FILES
    mode: str = "FAILFAST"
    sample: int = 0
    valid_fraction: float = VALID_FRACTION
    n_features: int = N_FEATURES
    tree_max_rows: int = models.TREE_MAX_ROWS
    tree_rounds: int = 120
    seed: int = models.SEED


def run_inventory(spark: SparkSession, root: str, out: str, options: Options = Options()) -> DataFrame:
    table = R.inventory(spark, root, options.files)
    sinks.write_json(table, f"{out}/interim/inventory")
    return table


def first_reports(found: DataFrame, deleted: DataFrame, report_id: Column, n: int) -> tuple[DataFrame, DataFrame]:
    """Of reports in order: those up to the n-th that is kept, in each quarter, and the kept ones among them."""
    place = F.struct(*R.DOCUMENT_ORDER)
    narrow = found.select("quarter", *R.DOCUMENT_ORDER, S.strip(report_id).alias("id"))
    kept = first_per_quarter(without_withdrawn(narrow, deleted, F.col("id")), n, [place])
    ends = kept.groupBy(F.col("quarter").alias("_q")).agg(F.count("*").alias("_n"), F.max(place).alias("_end"))
    ended = found.join(materialise(ends, "sample-ends"), F.col("quarter") == F.col("_q"), "left")
    seen = ended.where((F.coalesce("_n", F.lit(0)) < n) | (place <= F.col("_end"))).drop("_q", "_n", "_end")
    return seen, without_withdrawn(seen, deleted, report_id)


def run_etl(spark: SparkSession, root: str, out: str, options: Options = Options()) -> DataFrame:
    """Cases by quarter, split by time, and the parse log. With a sample, reading stops at the last report that is kept."""
    deleted, report_id = R.read_deleted_ids(spark, root), F.col("report.safetyreportid")
    found = R.read_reports(spark, root, options.files, options.mode)
    if options.sample:
        found, kept = first_reports(materialise(found, "reports-in-order"), deleted, report_id, options.sample)
    else:
        kept = without_withdrawn(found, deleted, report_id)
    # stored with each case's place in its file, which ties of the split go by
    placed = materialise(flatten_reports(kept, *R.DOCUMENT_ORDER), "etl-cases")
    sinks.write_cases(split_by_time(placed, options.valid_fraction).drop(*R.DOCUMENT_ORDER), f"{out}/interim/cases")
    cases = R.read_cases(spark, f"{out}/interim/cases")
    log = audit.parse_log(R.list_quarters(spark, root, options.files).select("quarter", "xml_files"), found, deleted, report_id, cases)
    sinks.write_json(log, f"{out}/interim/parse_log")
    return cases


def run_train(spark: SparkSession, out: str, options: Options = Options()) -> DataFrame:
    """Both models fitted on train, thresholds from valid, metrics of all splits and strata."""
    rows = models.model_rows(R.read_cases(spark, f"{out}/interim/cases")).persist()
    train = rows.where("split = 'train'")
    fitted = {
        "logistic": models.fit_logistic(train, options.n_features),
        "trees": models.fit_trees(train, rounds=options.tree_rounds, max_rows=options.tree_max_rows, seed=options.seed),
    }
    for name, model in fitted.items():
        sinks.save_model(model, f"{out}/models/{name}")
        models.score(model, rows, name).write.mode("overwrite").parquet(f"{out}/scores/{name}")
    rows.unpersist()
    scores = spark.read.parquet(*[f"{out}/scores/{name}" for name in fitted])
    thresholds = materialise(metrics.best_threshold(scores.where("split = 'valid'"), ["model"]), "thresholds")
    table = metrics.evaluate(scores, ["model", "split"], thresholds, ["model"])
    sinks.write_json(table, f"{out}/reports/model_metrics")
    chosen = metrics.with_threshold(scores.where(F.col("split").isin("valid", "test")), thresholds, ["model"])
    sinks.write_json(metrics.stratum_metrics(chosen, ["model", "split"], F.col("_chosen")), f"{out}/reports/strata")
    sinks.write_json(models.feature_config(spark, options.n_features), f"{out}/models/feature_config")
    return spark.read.json(f"{out}/reports/model_metrics")


def run_report(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The audit tables of the stored cases."""
    cases = R.read_cases(spark, f"{out}/interim/cases")
    tables = {
        "label_rates": audit.label_rates(cases),
        "missingness": audit.missingness(cases),
        "coverage": audit.coverage(cases),
        "weak_rules": audit.weak_rule_fires(cases),
        "weak_consensus": audit.weak_consensus(cases),
    }
    for name, table in tables.items():
        sinks.write_json(table, f"{out}/reports/{name}")
    return tables


def run_full(spark: SparkSession, root: str, out: str, options: Options = Options()) -> None:
    run_inventory(spark, root, out, options)
    run_etl(spark, root, out, options)
    run_train(spark, out, options)
    run_report(spark, out)
    sweep(spark)
