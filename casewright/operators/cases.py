"""Reports to case rows: from nested reports without a shuffle, or from header, drug and reaction tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import scalars as S
from casewright.functions.schema import CASE_COLUMNS, DRUG_FIELDS, HEADER_FIELDS, PATIENT_FIELDS, REACTION_FIELDS

Field = Callable[[str], Column]
NO_TEXT = "array<string>"


#: A step from fields to fields. Steps run one after another, each on the names that the one before gave, so that no
#: rule is worked out twice.
Step = Callable[[Field], dict[str, Column]]


def _clean_drug(field: Field) -> dict[str, Column]:
    """activesubstance is an array of names."""
    return {
        "code": S.strip(field("drugcharacterization")),
        "substance": S.substance_name(field("activesubstance")),
        "product": S.normalize_text(field("medicinalproduct")),
        "dose": S.strip(field("drugstructuredosagenumb")),
        "start": S.parse_date(field("drugstartdate")),
        "end": S.parse_date(field("drugenddate")),
        "indicated": S.strip(field("drugindication")) != "",
        "indication": S.normalize_text(field("drugindication")),
        "routed": S.strip(field("drugadministrationroute")) != "",
        "route": S.normalize_text(field("drugadministrationroute")),
        "acted": S.strip(field("actiondrug")) != "",
        "action": S.normalize_text(field("actiondrug")),
    }


def _named_drug(field: Field) -> dict[str, Column]:
    same = ("code", "start", "end", "indicated", "indication", "routed", "route", "acted", "action")
    named = field("substance") != ""
    return {n: field(n) for n in same} | {"name": F.when(named, field("substance")).otherwise(field("product")), "from_active": named, "dose": S.number_in(field("dose"))}


def _drug_facts(field: Field) -> dict[str, Column]:
    start, end = field("start"), field("end")
    tokens = F.array(
        F.when(field("code") != "", F.concat(F.lit("drugchar:"), field("code"))),
        S.normal_token("drug", field("name")),
        S.normal_token("indi", field("indication")),
        F.when(field("routed"), S.normal_joined("route", field("route"))),
        F.when(field("acted"), S.normal_joined("actiondrug", field("action"))),
    )
    return {
        "code": field("code"),
        "name": field("name"),
        "from_active": field("from_active"),
        "dose": field("dose"),
        "has_start": start.isNotNull(),
        "has_end": end.isNotNull(),
        "days": F.when(end >= start, F.date_diff(end, start)),
        "indication": F.when(field("indicated"), field("indication")),
        "tokens": tokens,
    }


def _clean_reaction(field: Field) -> dict[str, Column]:
    return {
        "name": S.normalize_text(field("reactionmeddrapt")),
        "ended": S.strip(field("reactionoutcome")) != "",
        "outcome": S.normalize_text(field("reactionoutcome")),
    }


def _reaction_facts(field: Field) -> dict[str, Column]:
    outcome = F.when(field("ended"), S.normal_joined("reactionoutcome", field("outcome")))
    return {"name": field("name"), "tokens": F.array(S.normal_token("reac", field("name")), outcome)}


#: What one drug, and one reaction, adds to its case.
DRUG_STEPS: tuple[Step, ...] = (_clean_drug, _named_drug, _drug_facts)
REACTION_STEPS: tuple[Step, ...] = (_clean_reaction, _reaction_facts)


def facts_table(rows: DataFrame, steps: tuple[Step, ...], key: str) -> DataFrame:
    """key and the facts of every row; columns that are not there count as missing."""
    field = lambda n: F.col(n) if n in rows.columns else F.lit(None).cast("string")
    for step in steps:
        rows = rows.select(key, *[c.alias(n) for n, c in step(field).items()])
        field = F.col
    return rows


def facts_array(array: Column, steps: tuple[Step, ...]) -> Column:
    """The facts of every element."""

    def one(step: Step) -> Callable[[Column], Column]:
        return lambda e: F.struct(*[c.alias(n) for n, c in step(lambda n: e[n]).items()])

    for step in steps:
        array = F.transform(array, one(step))
    return array


PLAIN_FIELDS = (*HEADER_FIELDS, "reportercountry", "qualification", "sendertype", "patientsex", "patientagegroup")


def with_header(rows: DataFrame, field: Field, *keep: str) -> DataFrame:
    """keep and the case columns that need no drugs or reactions."""
    measured = ("patientonsetage", "patientonsetageunit", "patientweight")
    clean = rows.select(*keep, *[S.strip(field(n)).alias(n) for n in (*PLAIN_FIELDS, *measured)])
    numbers = {"_age": S.number_in(F.col("patientonsetage")), "_factor": S.unit_years(F.col("patientonsetageunit")), "_weight": S.number_in(F.col("patientweight"))}
    parsed = clean.withColumns(numbers | {S.LABEL: S.label_from_flags()})
    done = S.with_round6(parsed, {"age_years": S.in_bounds(F.col("_age"), F.col("_factor")), "patientweight": F.col("_weight")})
    return done.select(*keep, *PLAIN_FIELDS, "age_years", "patientweight", S.LABEL)


def _joined(tokens: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.filter(tokens, lambda t: t.isNotNull() & (t != "")))), " ")


def _count(array: Column, keep: Callable[[Column], Column] | None = None) -> Column:
    return F.coalesce(F.size(array if keep is None else F.filter(array, keep)), F.lit(0)).cast("long")


def flatten_reports(reports: DataFrame, *carry: str) -> DataFrame:
    """Case rows of (quarter, source_file, report) rows, report being a struct of REPORT_FIELDS; columns in carry are handed on.

    Work stays inside the row: arrays are prepared once, then counted."""
    r = F.col("report")
    patient = F.get(r["patient"], F.lit(0))
    source, sender = F.get(r["primarysource"], F.lit(0)), F.get(r["sender"], F.lit(0))

    def field(name: str) -> Column:
        if name in HEADER_FIELDS:
            return r[name]
        if name in ("reportercountry", "qualification"):
            return source[name]
        return sender[name] if name == "sendertype" else patient[name]

    def drug(d: Column) -> Column:
        names = F.transform(d["activesubstance"], lambda s: s["activesubstancename"])
        return F.struct(names.alias("activesubstance"), *[d[n].alias(n) for n in DRUG_FIELDS])

    none = F.array()
    kept = reports.withColumns({"_drugs": F.transform(patient["drug"], drug), "_reactions": patient["reaction"]})
    headed = with_header(kept, field, "quarter", "source_file", *carry, "_drugs", "_reactions")
    prepared = headed.withColumns(
        {
            "_drugs": F.coalesce(facts_array(F.col("_drugs"), DRUG_STEPS), none),
            "_reactions": F.coalesce(facts_array(F.col("_reactions"), REACTION_STEPS), none),
        }
    )
    d, x = F.col("_drugs"), F.col("_reactions")
    listed = prepared.withColumns(
        {
            "_doses": F.filter(d["dose"], lambda v: v.isNotNull()),
            "_days": F.filter(d["days"], lambda v: v.isNotNull()),
        }
    )
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.when(F.size(a) > 0, F.size(a))
    days = F.col("_days")
    counted = listed.select(
        "*",
        S.quarter_split(F.col("quarter")).alias("split"),
        _count(d).alias("drug_count"),
        _count(d, lambda v: v["code"] == "1").alias("suspect_drug_count"),
        _count(d, lambda v: v["code"] == "2").alias("concomitant_drug_count"),
        _count(d, lambda v: v["code"] == "3").alias("interacting_drug_count"),
        _count(F.col("_doses")).alias("dose_available_count"),
        _count(d).alias("drug_name_count"),
        _count(d, lambda v: v["name"] != "").alias("drug_name_covered_count"),
        _count(d, lambda v: v["from_active"]).alias("active_substance_count"),
        _count(F.array_distinct(F.filter(d["name"], lambda v: v != ""))).alias("canonical_drug_count"),
        _count(x).alias("reaction_count"),
        _count(F.array_distinct(F.filter(x["name"], lambda v: v != ""))).alias("reaction_unique_count"),
        _count(F.array_distinct(F.filter(d["indication"], lambda v: v.isNotNull()))).alias("indication_count"),
        F.exists(d, lambda v: v["has_start"]).cast("int").alias("has_drug_start"),
        F.exists(d, lambda v: v["has_end"]).cast("int").alias("has_drug_end"),
        _joined(F.concat(F.flatten(d["tokens"]), F.flatten(x["tokens"]))).alias("text_tokens"),
    )
    summary = {
        "dose_value_mean": mean(F.col("_doses")),
        "duration_days_min": F.array_min(days).cast("double"),
        "duration_days_mean": mean(F.transform(days, lambda v: v.cast("double"))),
        "duration_days_max": F.array_max(days).cast("double"),
    }
    return S.with_round6(counted, summary).select(*CASE_COLUMNS, *carry)


def cases_from_tables(headers: DataFrame, drugs: DataFrame, reactions: DataFrame, key: str) -> DataFrame:
    """The same case rows from one row for each report, drug and reaction.

    Both child tables are summed up by key before they are joined, so rows never multiply and a report with very
    many drugs is summed in parts."""
    named = lambda df: (lambda n: F.col(n) if n in df.columns else F.lit(None).cast("string"))
    facts = facts_table(drugs, DRUG_STEPS, key)
    by_drug = facts.groupBy(key).agg(
        F.count("*").alias("drug_count"),
        F.count_if(F.col("code") == "1").alias("suspect_drug_count"),
        F.count_if(F.col("code") == "2").alias("concomitant_drug_count"),
        F.count_if(F.col("code") == "3").alias("interacting_drug_count"),
        F.count("dose").alias("dose_available_count"),
        F.avg("dose").alias("_dose"),
        F.min("days").cast("double").alias("_least"),
        F.avg("days").alias("_mean"),
        F.max("days").cast("double").alias("_most"),
        F.count_if(F.col("name") != "").alias("drug_name_covered_count"),
        F.count_if("from_active").alias("active_substance_count"),
        F.size(F.collect_set(F.nullif("name", F.lit("")))).cast("long").alias("canonical_drug_count"),
        F.size(F.collect_set("indication")).cast("long").alias("indication_count"),
        F.max("has_start").cast("int").alias("has_drug_start"),
        F.max("has_end").cast("int").alias("has_drug_end"),
        F.flatten(F.collect_set("tokens")).alias("_drug_tokens"),
    )
    sums = {"dose_value_mean": "_dose", "duration_days_min": "_least", "duration_days_mean": "_mean", "duration_days_max": "_most"}
    by_drug = S.with_round6(by_drug, {n: F.col(c) for n, c in sums.items()}).drop(*sums.values())
    react = facts_table(reactions, REACTION_STEPS, key)
    by_reaction = react.groupBy(key).agg(
        F.count("*").alias("reaction_count"),
        F.size(F.collect_set(F.nullif("name", F.lit("")))).cast("long").alias("reaction_unique_count"),
        F.flatten(F.collect_set("tokens")).alias("_reaction_tokens"),
    )
    # the shuffle that the joins need anyway, ahead of the work on the rows
    rows = with_header(headers.repartition(key), named(headers), key, "quarter", "source_file")
    joined = rows.join(by_drug, key, "left").join(by_reaction, key, "left")
    zero = [c for c in (*by_drug.columns, *by_reaction.columns) if c.endswith("_count") or c.startswith("has_")]
    tokens = lambda c: F.coalesce(F.col(c), F.array().cast(NO_TEXT))
    return (
        joined.fillna(0, zero)
        .withColumn("drug_name_count", F.col("drug_count"))
        .withColumn("split", S.quarter_split(F.col("quarter")))
        .withColumn("text_tokens", _joined(F.concat(tokens("_drug_tokens"), tokens("_reaction_tokens"))))
        .select(key, *CASE_COLUMNS)
    )


def nested_reports(headers: DataFrame, drugs: DataFrame, reactions: DataFrame, key: str) -> DataFrame:
    """(key, quarter, source_file, report) rows from header, drug and reaction tables."""
    text = lambda df, n: (F.col(n) if n in df.columns else F.lit(None)).cast("string").alias(n)
    substances = F.transform(F.col("activesubstance"), lambda s: F.struct(s.alias("activesubstancename"))).alias("activesubstance")
    drug_lists = drugs.groupBy(key).agg(F.collect_list(F.struct(*[text(drugs, n) for n in DRUG_FIELDS], substances)).alias("drug"))
    reaction_lists = reactions.groupBy(key).agg(F.collect_list(F.struct(*[text(reactions, n) for n in REACTION_FIELDS])).alias("reaction"))
    joined = headers.join(drug_lists, key, "left").join(reaction_lists, key, "left")
    patient = F.struct(*[text(headers, n) for n in PATIENT_FIELDS], "drug", "reaction")
    report = F.struct(
        *[text(headers, n) for n in HEADER_FIELDS],
        F.array(F.struct(text(headers, "reportercountry"), text(headers, "qualification"))).alias("primarysource"),
        F.array(F.struct(text(headers, "sendertype"))).alias("sender"),
        F.array(patient).alias("patient"),
    )
    return joined.select(key, "quarter", "source_file", report.alias("report"))


def without_withdrawn(reports: DataFrame, deleted: DataFrame, report_id: Column, small: bool = False) -> DataFrame:
    """Reports whose (quarter, id) is not in deleted (quarter, safetyreportid); empty ids always stay.

    small: the caller knows that the list is small enough to broadcast."""
    lists = deleted.where(F.col("safetyreportid") != "").select(F.col("quarter").alias("_q"), F.col("safetyreportid").alias("_id")).distinct()
    # an empty id matches nothing: its rows are spread, not gathered under one key
    own = F.when(S.strip(report_id) != "", S.strip(report_id)).otherwise(F.concat(F.lit("\n"), F.pmod(F.xxhash64(*reports.columns), F.lit(4096)).cast("string")))
    keyed = reports.withColumn("_own", own)
    return keyed.join(F.broadcast(lists) if small else lists, (F.col("quarter") == F.col("_q")) & (F.col("_own") == F.col("_id")), "left_anti").drop("_own")


def withdrawn(reports: DataFrame, deleted: DataFrame, report_id: Column) -> DataFrame:
    """Reports whose (quarter, id) is in deleted."""
    lists = deleted.where(F.col("safetyreportid") != "").select(F.col("quarter").alias("_q"), F.col("safetyreportid").alias("_id")).distinct()
    return reports.join(lists, (F.col("quarter") == F.col("_q")) & (S.strip(report_id) == F.col("_id")), "left_semi")
