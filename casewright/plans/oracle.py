"""SQL counterparts of the queries, for an independent engine over the same tables."""

from __future__ import annotations

from casewright.functions.scalars import SERIOUSNESS_FLAGS, YEARS_PER_UNIT
from casewright.functions.schema import CASE_COLUMNS, CATEGORICAL_FEATURES, MISSINGNESS_FIELDS, NUMERIC_FEATURES
from casewright.plans.testbed import DELETED, DRUGS, HEADERS, REACTIONS, SCORES, plain


def strip(x: str) -> str:
    return f"coalesce(regexp_replace(regexp_replace({x}, '^\\s+', ''), '\\s+$', ''), '')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(upper({strip(x)}), '[^A-Z0-9]+', ' ', 'g'))"


def num(x: str) -> str:
    s = strip(x)
    return f"coalesce(try_cast(replace({s}, ',', '') AS DOUBLE), try_cast(nullif(regexp_extract({s}, '-?\\d+(?:\\.\\d+)?'), '') AS DOUBLE))"


def six(x: str) -> str:
    return f"CASE WHEN isfinite({x}) THEN CAST(printf('%.5e', {x}) AS DOUBLE) END"


def day(x: str) -> str:
    head = f"left({strip(x)}, 8)"
    return f"CASE WHEN regexp_full_match({head}, '[0-9]{{8}}') AND left({head}, 4) <> '0000' THEN CAST(try_strptime({head}, '%Y%m%d') AS DATE) END"


def token(prefix: str, x: str) -> str:
    n = norm(x)
    return f"CASE WHEN {n} <> '' THEN concat('{prefix}:', left(replace({n}, ' ', '_'), 120)) END"


def joined(prefix: str, x: str) -> str:
    return f"CASE WHEN {strip(x)} <> '' THEN concat('{prefix}:', replace({norm(x)}, ' ', '_')) END"


def age(value: str, unit: str) -> str:
    units = " ".join(f"WHEN '{k}' THEN {v!r}::DOUBLE" for k, v in YEARS_PER_UNIT.items())
    years = f"(CASE WHEN {num(value)} >= 0 THEN {num(value)} * CASE {strip(unit)} {units} END END)"
    return f"CASE WHEN {years} <= 130 THEN {six(years)} END"


def age_bin(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'unknown' WHEN {x} < 18 THEN 'child' WHEN {x} < 65 THEN 'adult' ELSE 'senior' END"


def count_bin(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'unknown' WHEN {x} <= 0 THEN '0' WHEN {x} = 1 THEN '1' WHEN {x} <= 4 THEN '2_4' WHEN {x} <= 9 THEN '5_9' ELSE '10_plus' END"


LABEL = "CASE WHEN " + " OR ".join(f"{strip(f)} = '1'" for f in SERIOUSNESS_FLAGS) + " THEN 1 ELSE 0 END"
SPLIT = "CASE WHEN CAST(right(quarter, 1) AS INTEGER) <= 3 THEN 'train' ELSE 'q4_pending' END"
ID_KEY_LIST = (
    "CASE WHEN regexp_full_match(safetyreportid, '[0-9]+') THEN 0 ELSE 1 END",
    "CASE WHEN regexp_full_match(safetyreportid, '[0-9]+') THEN length(ltrim(safetyreportid, '0')) ELSE 0 END",
    "CASE WHEN regexp_full_match(safetyreportid, '[0-9]+') THEN ltrim(safetyreportid, '0') ELSE safetyreportid END",
)
ID_KEYS = ", ".join(ID_KEY_LIST)

DRUG_FACTS = f"""
SELECT k, {strip("drugcharacterization")} AS code,
       CASE WHEN {norm("substance")} <> '' THEN {norm("substance")} ELSE {norm("medicinalproduct")} END AS name,
       {norm("substance")} <> '' AS from_active,
       {num("drugstructuredosagenumb")} AS dose,
       {day("drugstartdate")} AS first_day, {day("drugenddate")} AS last_day,
       CASE WHEN {strip("drugindication")} <> '' THEN {norm("drugindication")} END AS indication,
       {token("indi", "drugindication")} AS t1, {joined("route", "drugadministrationroute")} AS t2, {joined("actiondrug", "actiondrug")} AS t3
FROM drugs
"""
REACTION_FACTS = f"""
SELECT k, {norm("reactionmeddrapt")} AS name, {token("reac", "reactionmeddrapt")} AS t1, {joined("reactionoutcome", "reactionoutcome")} AS t2 FROM reactions
"""
BY_DRUG = f"""
SELECT k, count(*) AS drug_count, count(*) FILTER (code = '1') AS suspect_drug_count, count(*) FILTER (code = '2') AS concomitant_drug_count,
       count(*) FILTER (code = '3') AS interacting_drug_count, count(dose) AS dose_available_count, {six("avg(dose)")} AS dose_value_mean,
       {six("CAST(min(days) AS DOUBLE)")} AS duration_days_min, {six("avg(days)")} AS duration_days_mean, {six("CAST(max(days) AS DOUBLE)")} AS duration_days_max,
       count(*) FILTER (name <> '') AS drug_name_covered_count, count(*) FILTER (from_active) AS active_substance_count,
       count(DISTINCT nullif(name, '')) AS canonical_drug_count, count(DISTINCT indication) AS indication_count,
       max(CAST(first_day IS NOT NULL AS INTEGER)) AS has_drug_start, max(CAST(last_day IS NOT NULL AS INTEGER)) AS has_drug_end,
       flatten(list([CASE WHEN code <> '' THEN concat('drugchar:', code) END, {token("drug", "name")}, t1, t2, t3])) AS drug_tokens
FROM (SELECT *, CASE WHEN last_day >= first_day THEN date_diff('day', first_day, last_day) END AS days FROM drug_facts) AS f GROUP BY k
"""
BY_REACTION = """
SELECT k, count(*) AS reaction_count, count(DISTINCT nullif(name, '')) AS reaction_unique_count, flatten(list([t1, t2])) AS reaction_tokens
FROM reaction_facts GROUP BY k
"""
_DRUG_COUNTS = [
    "drug_count",
    "suspect_drug_count",
    "concomitant_drug_count",
    "interacting_drug_count",
    "dose_available_count",
    "drug_name_covered_count",
    "active_substance_count",
    "canonical_drug_count",
    "indication_count",
    "has_drug_start",
    "has_drug_end",
]
_TEXT = [
    "safetyreportversion",
    "receivedate",
    "receiptdate",
    "transmissiondate",
    "primarysourcecountry",
    "occurcountry",
    "reporttype",
    "fulfillexpeditecriteria",
    "duplicate",
    "reportercountry",
    "qualification",
    "sendertype",
    "patientsex",
    "patientagegroup",
]
CASES = f"""
SELECT k, quarter, {SPLIT} AS split, source_file, {strip("safetyreportid")} AS safetyreportid,
       {", ".join(f"{strip(c)} AS {c}" for c in (*_TEXT, *SERIOUSNESS_FLAGS))},
       {age("patientonsetage", "patientonsetageunit")} AS age_years, {six(num("patientweight"))} AS patientweight,
       {LABEL} AS label_serious,
       {", ".join(f"coalesce({c}, 0) AS {c}" for c in _DRUG_COUNTS)}, coalesce(drug_count, 0) AS drug_name_count,
       dose_value_mean, duration_days_min, duration_days_mean, duration_days_max,
       coalesce(reaction_count, 0) AS reaction_count, coalesce(reaction_unique_count, 0) AS reaction_unique_count,
       array_to_string(list_sort(list_distinct(list_filter(list_concat(coalesce(drug_tokens, []), coalesce(reaction_tokens, [])), lambda t: t IS NOT NULL))), ' ') AS text_tokens
FROM headers LEFT JOIN by_drug USING (k) LEFT JOIN by_reaction USING (k)
"""
_PARTS = {
    "headers": plain(HEADERS),
    "drugs": plain(DRUGS),
    "reactions": plain(REACTIONS),
    "deleted": f"SELECT DISTINCT quarter, safetyreportid FROM ({plain(DELETED)}) AS d WHERE safetyreportid <> ''",
    "drug_facts": DRUG_FACTS,
    "reaction_facts": REACTION_FACTS,
    "by_drug": BY_DRUG,
    "by_reaction": BY_REACTION,
    "cases": CASES,
    "kept": "SELECT * FROM cases AS c WHERE NOT EXISTS (SELECT 1 FROM deleted AS d WHERE d.quarter = c.quarter AND d.safetyreportid = c.safetyreportid)",
    "day_keyed": f"SELECT *, coalesce({day('receivedate')}, DATE '9999-12-31') AS _day FROM kept",
    "split_cases": f"""
        SELECT * REPLACE (CASE WHEN split = 'train' THEN 'train'
               WHEN row_number() OVER (PARTITION BY quarter ORDER BY _day, {ID_KEYS}, k) <= floor(count(*) OVER (PARTITION BY quarter) * 0.5::DOUBLE)
               THEN 'valid' ELSE 'test' END AS split) FROM day_keyed""",
    "scores": plain(SCORES),
}
_NEEDS = {
    "drug_facts": ["drugs"],
    "reaction_facts": ["reactions"],
    "by_drug": ["drug_facts"],
    "by_reaction": ["reaction_facts"],
    "cases": ["headers", "by_drug", "by_reaction"],
    "kept": ["cases", "deleted"],
    "day_keyed": ["kept"],
    "split_cases": ["day_keyed"],
}


def with_parts(sql: str, *names: str, **more: str) -> str:
    """sql with the tables it names, and those these need, before it."""
    order: list[str] = []

    def need(name: str) -> None:
        for below in _NEEDS.get(name, []):
            need(below)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    parts = [f"{n} AS ({_PARTS[n]})" for n in order] + [f"{n} AS ({s})" for n, s in more.items()]
    return f"WITH {', '.join(parts)} {sql}" if parts else sql


CASE_LIST = ", ".join(CASE_COLUMNS)
_ARR = {
    "arr_drug_counts": ["drug_count", "drug_name_count", "suspect_drug_count", "concomitant_drug_count", "interacting_drug_count"],
    "arr_drug_coverage": ["drug_name_covered_count", "active_substance_count", "canonical_drug_count"],
    "arr_dose_summary": ["dose_available_count", "dose_value_mean"],
    "arr_duration_summary": ["duration_days_min", "duration_days_mean", "duration_days_max", "has_drug_start", "has_drug_end"],
    "arr_indications": ["indication_count"],
    "arr_reactions": ["reaction_count", "reaction_unique_count"],
    "arr_text_tokens": ["text_tokens"],
}
ARRAY_QUERIES = _ARR

HASH_TEXT = (
    "concat_ws(' ', "
    + ", ".join(f"CASE WHEN {norm(c)} <> '' THEN concat('{c}:', replace({norm(c)}, ' ', '_')) END" for c in CATEGORICAL_FEATURES)
    + f", concat('age_bin:', {age_bin('age_years')})"
    + "".join(f", concat('{c}_bin:', {count_bin(c)})" for c in ("drug_count", "reaction_count", "indication_count"))
    + ", nullif(text_tokens, ''))"
)
NUMERIC = ", ".join(f"{num(f'CAST({c} AS VARCHAR)')} AS {c}" for c in NUMERIC_FEATURES)

VOTES = """
SELECT k, label_serious,
       CASE WHEN contains(text_tokens, 'DEATH') OR contains(text_tokens, 'FATAL') OR contains(text_tokens, 'CARDIAC_ARREST') THEN 1 END AS death_or_fatal_reaction_term,
       CASE WHEN drug_count >= 10 THEN 1 END AS high_polypharmacy_10plus,
       CASE WHEN age_years >= 65 AND suspect_drug_count >= 2 THEN 1 END AS senior_with_multiple_suspect_drugs,
       CASE WHEN age_years < 50 AND drug_count <= 2 AND reaction_count <= 1 THEN 0 END AS low_complexity_younger_case
FROM cases
"""
_RULES = ("death_or_fatal_reaction_term", "high_polypharmacy_10plus", "senior_with_multiple_suspect_drugs", "low_complexity_younger_case")
_ANY = lambda v: " OR ".join(f"coalesce({r} = {v}, false)" for r in _RULES)

RANKED = "SELECT model, split, score, count(*) AS n, sum(label) AS pos FROM scores GROUP BY ALL"
CUMULATIVE = """
SELECT *, coalesce(sum(n) OVER w, 0) AS n_above, coalesce(sum(pos) OVER w, 0) AS pos_above,
       sum(n) OVER (PARTITION BY model, split) AS n_all, sum(pos) OVER (PARTITION BY model, split) AS pos_all
FROM ranked WINDOW w AS (PARTITION BY model, split ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""
AREAS = """
SELECT model, split,
       CASE WHEN max(pos_all) > 0 AND max(n_all - pos_all) > 0 THEN sum((n - pos) * (pos_above + pos / 2.0::DOUBLE)) / (max(pos_all)::DOUBLE * max(n_all - pos_all)) END AS auroc,
       CASE WHEN max(pos_all) > 0 AND max(n_all - pos_all) > 0 THEN sum(pos * ((pos_above + pos)::DOUBLE / (n_above + n)::DOUBLE)) / max(pos_all) END AS average_precision
FROM cumulative GROUP BY model, split
"""
TOPS = f"""
SELECT model, split, percent, k,
       CASE WHEN positives > 0 THEN hits::DOUBLE / positives END AS recall, hits::DOUBLE / k AS hit_rate
FROM (SELECT model, split, percent, CAST(max(kk) AS BIGINT) AS k, sum(label) AS positives, sum(label) FILTER (place <= kk) AS hits
      FROM (SELECT model, split, label, percent, row_number() OVER (PARTITION BY model, split, percent ORDER BY score DESC, {ID_KEYS}) AS place,
                   greatest(1, ceil(count(*) OVER (PARTITION BY model, split, percent) * (percent::DOUBLE / 100.0::DOUBLE))) AS kk
            FROM scores, (VALUES (1), (5), (10)) AS p(percent)) AS a GROUP BY model, split, percent) AS b
"""


def confusion(keys: str, source: str, threshold: str) -> str:
    return f"""
SELECT {keys}, n, positives, positives::DOUBLE / n AS positive_rate, threshold,
       coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(positives, 0), 0) AS recall,
       coalesce(2.0::DOUBLE * tp / nullif(tp + fp + positives, 0), 0) AS f1
FROM (SELECT {keys}, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, max({threshold}) AS threshold,
             count(*) FILTER (score >= {threshold} AND label = 1) AS tp, count(*) FILTER (score >= {threshold} AND label = 0) AS fp
      FROM {source} GROUP BY {keys}) AS c
"""


_2_32 = "4294967296::UBIGINT"
#: 32-bit Murmur3 (seed 42) of tokens of ASCII letters, step by step, and the place among 2**18.
MURMUR3 = {
    "letters": "SELECT token, len(token)::UBIGINT AS n, list_transform(string_split(token, ''), lambda x: ord(x)::UBIGINT) AS b FROM (SELECT DISTINCT token FROM counted) AS t",
    "blocks": """SELECT token, n, list_transform(range(0, CAST((n + 3) // 4 AS BIGINT)), lambda i: coalesce(b[4 * i + 1], 0::UBIGINT) + 256::UBIGINT * coalesce(b[4 * i + 2], 0::UBIGINT)
                        + 65536::UBIGINT * coalesce(b[4 * i + 3], 0::UBIGINT) + 16777216::UBIGINT * coalesce(b[4 * i + 4], 0::UBIGINT)) AS w FROM letters""",
    "mixed_1": f"SELECT token, n, list_transform(w, lambda k: (k * {0xCC9E2D51}::UBIGINT) % {_2_32}) AS w FROM blocks",
    "mixed_2": f"SELECT token, n, list_transform(w, lambda k: (k * 32768::UBIGINT) % {_2_32} + k // 131072::UBIGINT) AS w FROM mixed_1",
    "mixed_3": f"SELECT token, n, list_transform(w, lambda k: (k * {0x1B873593}::UBIGINT) % {_2_32}) AS w FROM mixed_2",
    "summed": f"""SELECT token, n, if(n % 4 > 0, w[-1], 0::UBIGINT) AS rest,
                         list_reduce([42::UBIGINT] || w[1:CAST(n // 4 AS BIGINT)], lambda h, k: (((xor(h, k) * 8192::UBIGINT) % {_2_32} + xor(h, k) // 524288::UBIGINT) * 5::UBIGINT + {0xE6546B64}::UBIGINT) % {_2_32}) AS h
                  FROM mixed_3""",
    "final_1": "SELECT token, xor(xor(h, rest), n) AS h FROM summed",
    "final_2": f"SELECT token, (xor(h, h // 65536::UBIGINT) * {0x85EBCA6B}::UBIGINT) % {_2_32} AS h FROM final_1",
    "final_3": f"SELECT token, (xor(h, h // 8192::UBIGINT) * {0xC2B2AE35}::UBIGINT) % {_2_32} AS h FROM final_2",
    "placed": "SELECT token, CAST(xor(h, h // 65536::UBIGINT) % 262144::UBIGINT AS BIGINT) AS place FROM final_3",
}
GRID = "[" + ", ".join(f"{i / 20.0!r}::DOUBLE" for i in range(1, 20)) + "]"
CANDIDATES = f"""
SELECT model, unnest(list_distinct(list_concat({GRID}, quantile_cont(score, [{", ".join(repr(i / 20.0) for i in range(1, 20))}])))) AS threshold
FROM scores WHERE split = 'valid' GROUP BY model
"""
AT_THRESHOLD = """
SELECT model, threshold, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives,
       count(*) FILTER (score >= threshold AND label = 1) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp
FROM candidates JOIN (SELECT * FROM scores WHERE split = 'valid') AS v USING (model) GROUP BY model, threshold
"""
CURVE = "SELECT *, coalesce(2.0::DOUBLE * tp / nullif(tp + fp + positives, 0), 0) AS f1 FROM at_threshold"
BEST = "SELECT model, threshold, f1 FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) AS place FROM curve) AS r WHERE place = 1"
STRATA = f"""
SELECT model, split, safetyreportid, label, score, 'sex' AS stratum, CASE WHEN patientsex = '' THEN 'unknown' ELSE patientsex END AS value FROM scores
UNION ALL SELECT model, split, safetyreportid, label, score, 'age_bin', {age_bin("age_years")} FROM scores
UNION ALL SELECT model, split, safetyreportid, label, score, 'quarter', quarter FROM scores
"""
#: This engine's upper() leaves ß as it is.
_SHARP = "replace(text, 'ß', 'SS')"
_R9 = "round({0}, 9) AS {0}"


def rounded(*names: str) -> str:
    return ", ".join(_R9.format(n) for n in names)


ORACLE: dict[str, str] = {
    "src_reports_xml": with_parts(f"SELECT {CASE_LIST} FROM cases", "cases"),
    "src_quarters": with_parts("SELECT DISTINCT quarter, source_file FROM headers", "headers"),
    "src_deleted_ids": with_parts("SELECT quarter, safetyreportid FROM deleted", "deleted"),
    "snk_cases": with_parts(f"SELECT {CASE_LIST} FROM split_cases", "split_cases"),
    "src_cases": with_parts("SELECT quarter, safetyreportid, label_serious, text_tokens FROM split_cases WHERE split = 'valid'", "split_cases"),
    "flt_split": with_parts("SELECT k, split, safetyreportid FROM split_cases WHERE split = 'test'", "split_cases"),
    "prj_case_header": with_parts(
        f"SELECT k, safetyreportid, {', '.join(_TEXT)}, age_years, patientweight FROM cases", "cases"
    ),
    "prj_label": with_parts(f"SELECT k, {LABEL} AS label_serious FROM headers", "headers"),
    "prj_leakage_drop": with_parts(f"SELECT {', '.join(c for c in CASE_COLUMNS if c not in (*SERIOUSNESS_FLAGS, 'label_serious'))} FROM cases", "cases"),
    "flt_missing_id": with_parts(f"SELECT k, {strip('safetyreportid')} = '' AS missing_id FROM headers", "headers"),
    "prj_weak_votes": with_parts(f"SELECT k, {', '.join(_RULES)} FROM votes", "cases", votes=VOTES),
    "fn_strip": with_parts(f"SELECT k, {strip('safetyreportid')} AS stripped FROM headers", "headers"),
    "fn_parse_float": with_parts(f"SELECT k, drugstructuredosagenumb AS text, {num('drugstructuredosagenumb')} AS value FROM drugs", "drugs"),
    "fn_round6": f"SELECT o_orderkey AS k, {six('sqrt(o_totalprice)')} AS rounded, {six('sqrt(o_totalprice) / 1e7')} AS small FROM orders",
    "fn_parse_date": with_parts(f"SELECT k, receivedate, {day('receivedate')} AS day FROM headers", "headers"),
    "fn_age_years": with_parts(f"SELECT k, {age('patientonsetage', 'patientonsetageunit')} AS age_years FROM headers", "headers"),
    "fn_age_bin": with_parts(f"SELECT k, {age_bin('age_years')} AS age_bin FROM cases", "cases"),
    "fn_count_bin": with_parts(f"SELECT k, {count_bin('drug_count')} AS bin, {count_bin('dose_value_mean')} AS mean_bin FROM cases", "cases"),
    "fn_normalize_text": f"SELECT doc_id, {norm(_SHARP)} AS normalized FROM documents",
    "fn_make_token": f"SELECT doc_id, coalesce({token('item', _SHARP)}, '') AS token FROM documents",
    "fn_canonical_drug": with_parts("SELECT k, name, from_active, count(*) AS n FROM drug_facts GROUP BY ALL", "drug_facts"),
    "fn_quarter_split": with_parts(f"SELECT k, quarter, {SPLIT} AS split FROM headers", "headers"),
    "fn_report_id_sort_key": with_parts(f"SELECT k, {ID_KEY_LIST[0]} AS kind, {ID_KEY_LIST[1]} AS length, {ID_KEY_LIST[2]} AS text FROM (SELECT k, {strip('safetyreportid')} AS safetyreportid FROM headers) AS h", "headers"),
    "fn_numeric_value": with_parts(f"SELECT k, {num('qualification')} AS qualification, {num('patientsex')} AS patientsex FROM headers", "headers"),
    "fn_pct": with_parts("SELECT quarter, round(100.0::DOUBLE * sum(label_serious) / count(*), 9) AS serious_pct, CASE WHEN sum(drug_count) > 0 THEN round(100.0::DOUBLE * sum(active_substance_count) / sum(drug_count), 9) END AS active_pct FROM cases GROUP BY quarter", "cases"),
    **{name: with_parts(f"SELECT k, {', '.join(columns)} FROM cases", "cases") for name, columns in _ARR.items()},
    "arr_misc_tokens": with_parts(
        "SELECT k, array_to_string(list_sort(list_distinct(list_filter(flatten(list([concat('drugchar:', code), t2, t3])), lambda t: t IS NOT NULL))), ' ') AS misc_tokens FROM drug_facts GROUP BY k",
        "drug_facts",
    ),
    "join_deleted_anti": with_parts("SELECT k, quarter, safetyreportid FROM kept", "kept"),
    "join_deleted_semi": with_parts("SELECT c.quarter, count(*) AS deleted_skipped FROM cases AS c JOIN deleted AS d ON c.quarter = d.quarter AND c.safetyreportid = d.safetyreportid GROUP BY c.quarter", "cases", "deleted"),
    "join_case_children": with_parts(f"SELECT k, {CASE_LIST} FROM cases", "cases"),
    "join_threshold_candidates": with_parts("SELECT model, round(threshold, 9) AS threshold, n, positives, tp, fp, round(f1, 9) AS f1 FROM curve", "scores", candidates=CANDIDATES, at_threshold=AT_THRESHOLD, curve=CURVE),
    "join_score_metadata": with_parts(f"SELECT model, k, split, quarter, patientsex, {age_bin('age_years')} AS age_bin, label, score FROM scores", "scores"),
    "set_union_quarters": with_parts("SELECT quarter, count(*) AS n FROM headers GROUP BY quarter", "headers"),
    "set_token_union": with_parts(
        "SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text_tokens, ' ')) AS token FROM cases WHERE text_tokens <> '') AS t GROUP BY token", "cases"
    ),
    "set_threshold_union": with_parts("SELECT model, round(threshold, 9) AS threshold FROM candidates", "scores", candidates=CANDIDATES),
    "agg_inventory": with_parts(
        """SELECT quarter, CAST(sum(files) AS BIGINT) AS xml_files, CAST(sum(reports) AS BIGINT) AS reports, CAST(sum(deleted_ids) AS BIGINT) AS deleted_ids
           FROM (SELECT h.quarter, count(DISTINCT source_file) AS files, count(*) AS reports, coalesce(max(gone), 0) AS deleted_ids
                 FROM headers AS h LEFT JOIN (SELECT quarter AS q, count(*) AS gone FROM deleted GROUP BY quarter) AS d ON h.quarter = q GROUP BY h.quarter) AS t
           GROUP BY ROLLUP (quarter)""",
        "headers",
        "deleted",
    ),
    "agg_file_reports": with_parts("SELECT quarter, source_file, count(*) AS reports FROM headers GROUP BY quarter, source_file", "headers"),
    "agg_parse_log": with_parts(
        f"""SELECT l.*, count(*) FILTER (s.split = 'train') AS train_cases, count(*) FILTER (s.split = 'valid') AS valid_cases, count(*) FILTER (s.split = 'test') AS test_cases
            FROM (SELECT quarter, count(DISTINCT source_file) AS xml_files, count(*) AS parsed, count(d.safetyreportid) AS deleted_skipped,
                         count(*) FILTER ({strip('h.safetyreportid')} = '') AS missing_id, count(*) - count(d.safetyreportid) AS kept
                  FROM headers AS h LEFT JOIN (SELECT quarter AS dq, safetyreportid FROM deleted) AS d ON h.quarter = dq AND {strip('h.safetyreportid')} = d.safetyreportid GROUP BY quarter) AS l
            LEFT JOIN split_cases AS s ON l.quarter = s.quarter GROUP BY ALL""",
        "headers",
        "split_cases",
    ),
    "agg_label_rates": with_parts(
        """SELECT CASE WHEN grouping(quarter) = 0 THEN 'quarter' WHEN grouping(split) = 0 THEN 'split' ELSE 'all' END AS level,
                  coalesce(quarter, split, 'all') AS value, count(*) AS n, CAST(sum(label_serious) AS BIGINT) AS positives, round(sum(label_serious)::DOUBLE / count(*), 9) AS rate
           FROM split_cases GROUP BY GROUPING SETS ((quarter), (split), ())""",
        "split_cases",
    ),
    "agg_missingness": with_parts(
        " UNION ALL ".join(
            f"SELECT '{c}' AS field, count(*) FILTER (coalesce(CAST({c} AS VARCHAR), '') = '') AS missing, round(count(*) FILTER (coalesce(CAST({c} AS VARCHAR), '') = '')::DOUBLE / count(*), 9) AS rate FROM cases"
            for c in MISSINGNESS_FIELDS
        ),
        "cases",
    ),
    "agg_coverage": with_parts(
        """SELECT count(*) AS n, CAST(sum(drug_count) AS BIGINT) AS drug_count, CAST(sum(drug_name_covered_count) AS BIGINT) AS drug_name_covered_count,
                  CAST(sum(active_substance_count) AS BIGINT) AS active_substance_count, CAST(sum(reaction_count) AS BIGINT) AS reaction_count,
                  CAST(sum(indication_count) AS BIGINT) AS indication_count, round(sum(drug_name_covered_count)::DOUBLE / sum(drug_count), 9) AS name_coverage,
                  round(sum(active_substance_count)::DOUBLE / sum(drug_count), 9) AS active_substance_coverage FROM cases""",
        "cases",
    ),
    "agg_weak_rules": with_parts(
        "SELECT rule, fires, positives FROM ("
        + " UNION ALL ".join(f"SELECT '{r}' AS rule, count({r}) AS fires, count(*) FILTER ({r} IS NOT NULL AND label_serious = 1) AS positives FROM votes" for r in _RULES)
        + ") AS u WHERE fires > 0",
        "cases",
        votes=VOTES,
    ),
    "agg_weak_consensus": with_parts(
        """SELECT n, covered, conflicts, voted, agreements, round(covered::DOUBLE / n, 9) AS coverage_rate, round(conflicts::DOUBLE / covered, 9) AS conflict_rate,
                  round(agreements::DOUBLE / voted, 9) AS agreement_rate
           FROM (SELECT count(*) AS n, count(*) FILTER (pos OR neg) AS covered, count(*) FILTER (pos AND neg) AS conflicts, count(*) FILTER (pos <> neg) AS voted,
                        count(*) FILTER (pos <> neg AND CAST(pos AS INTEGER) = label_serious) AS agreements FROM flags) AS s""",
        "cases",
        votes=VOTES,
        flags=f"SELECT label_serious, ({_ANY(1)}) AS pos, ({_ANY(0)}) AS neg FROM votes",
    ),
    "agg_class_weights": with_parts(
        """SELECT split, label, n, round(CASE WHEN n > 0 THEN total / (2.0::DOUBLE * n) ELSE 1.0 END, 9) AS weight
           FROM (SELECT split, l.label, count(*) FILTER (label_serious = l.label) AS n, count(*) AS total FROM split_cases, (VALUES (0), (1)) AS l(label) GROUP BY split, l.label) AS c""",
        "split_cases",
    ),
    "agg_token_counts": with_parts(
        f"SELECT k, token, count(*) AS n FROM (SELECT k, unnest(regexp_extract_all({HASH_TEXT}, '\\b\\S+\\b')) AS token FROM cases) AS t GROUP BY k, token", "cases"
    ),
    "win_time_split": with_parts("SELECT k, quarter, split FROM split_cases", "split_cases"),
    "lim_sample_per_quarter": with_parts(
        "SELECT k, quarter FROM (SELECT k, quarter, row_number() OVER (PARTITION BY quarter ORDER BY source_file, k) AS place FROM kept) AS r WHERE place <= 100", "kept"
    ),
    "smp_train_cap": with_parts(
        "SELECT k, safetyreportid FROM (SELECT k, safetyreportid, row_number() OVER (ORDER BY md5(concat('42:', CAST(k AS VARCHAR))), CAST(k AS VARCHAR)) AS place FROM split_cases WHERE split = 'train') AS r WHERE place <= 2000",
        "split_cases",
    ),
    "top_recall_at_pct": with_parts("SELECT model, split, percent, k, round(recall, 9) AS recall FROM tops", "scores", tops=TOPS),
    "top_hit_rate_at_pct": with_parts("SELECT model, split, percent, k, round(hit_rate, 9) AS hit_rate FROM tops", "scores", tops=TOPS),
    "win_cumulative_scores": with_parts(
        "SELECT model, split, score, n, CAST(pos AS BIGINT) AS pos, CAST(n_above AS BIGINT) AS n_above, CAST(pos_above AS BIGINT) AS pos_above FROM cumulative", "scores", ranked=RANKED, cumulative=CUMULATIVE
    ),
    "srt_reports": with_parts("SELECT quarter, split, count(*) AS n, row_number() OVER (ORDER BY quarter, split) AS place FROM split_cases GROUP BY quarter, split", "split_cases"),
    "ftr_hash_text": with_parts(f"SELECT k, {HASH_TEXT} AS hash_text FROM cases", "cases"),
    "ftr_numeric_matrix": with_parts(f"SELECT k, {NUMERIC} FROM cases", "cases"),
    "met_confusion": with_parts(f"SELECT model, split, n, positives, threshold, {rounded('positive_rate', 'precision', 'recall', 'f1')} FROM c0", "scores", c0=confusion("model, split", "scores", "0.5::DOUBLE")),
    "met_auroc": with_parts("SELECT model, split, round(auroc, 9) AS auroc FROM areas", "scores", ranked=RANKED, cumulative=CUMULATIVE, areas=AREAS),
    "met_average_precision": with_parts("SELECT model, split, round(average_precision, 9) AS average_precision FROM areas", "scores", ranked=RANKED, cumulative=CUMULATIVE, areas=AREAS),
    "met_best_threshold": with_parts("SELECT model, round(threshold, 9) AS threshold, round(f1, 9) AS f1 FROM best", "scores", candidates=CANDIDATES, at_threshold=AT_THRESHOLD, curve=CURVE, best=BEST),
    "met_strata": with_parts(
        f"""SELECT c0.model, c0.split, c0.stratum, c0.value, n, positives, threshold, {rounded('positive_rate', 'precision', 'recall', 'f1')}, round(auroc, 9) AS auroc, round(average_precision, 9) AS average_precision,
                   {", ".join(f"round(p{p}.{m[0]}, 9) AS {m}_top{p}" for p in (1, 5, 10) for m in ("recall", "hit_rate"))}
            FROM c0 JOIN areas2 USING (model, split, stratum, value)
            {" ".join(f"JOIN (SELECT model, split, stratum, value, recall AS r, hit_rate AS h FROM tops2 WHERE percent = {p}) AS p{p} USING (model, split, stratum, value)" for p in (1, 5, 10))} WHERE n >= 20""",
        "scores",
        strata=STRATA,
        wanted="SELECT * FROM strata WHERE split IN ('valid', 'test')",
        c0=confusion("model, split, stratum, value", "wanted", "0.5::DOUBLE"),
        ranked=RANKED.replace("model, split,", "model, split, stratum, value,").replace("FROM scores", "FROM wanted"),
        cumulative=CUMULATIVE.replace("BY model, split", "BY model, split, stratum, value"),
        areas2=AREAS.replace("model, split", "model, split, stratum, value"),
        tops2=TOPS.replace("model, split", "model, split, stratum, value").replace("FROM scores,", "FROM wanted,"),
    ),
    "met_split_table": with_parts(
        f"""SELECT model, split, n, positives, threshold, {rounded('positive_rate', 'precision', 'recall', 'f1')}, round(auroc, 9) AS auroc, round(average_precision, 9) AS average_precision,
                   {", ".join(f"(SELECT round(max({m}), 9) FROM tops AS t WHERE t.model = c0.model AND t.split = c0.split AND percent = {p}) AS {m}_top{p}" for p in (1, 5, 10) for m in ("recall", "hit_rate"))}
            FROM c0 JOIN areas USING (model, split)""",
        "scores",
        candidates=CANDIDATES,
        at_threshold=AT_THRESHOLD,
        curve=CURVE,
        best=BEST,
        chosen="SELECT s.*, b.threshold AS t FROM scores AS s JOIN best AS b ON s.model = b.model",
        c0=confusion("model, split", "chosen", "t"),
        ranked=RANKED,
        cumulative=CUMULATIVE,
        areas=AREAS,
        tops=TOPS,
    ),
    "stm_ingest_cases": with_parts(f"SELECT {CASE_LIST} FROM kept", "kept"),
    "mdl_score_from_table": with_parts("SELECT split, label_serious AS label, count(*) AS n, CAST(0 AS BIGINT) AS differing FROM split_cases GROUP BY ALL", "split_cases"),
    "ftr_hashed_vector": with_parts(
        """SELECT k, count(*) AS tokens, CAST(sum(place) AS BIGINT) AS places, round(sum((n / size) * (n / size)), 6) AS norm, round(max(n / size), 9) AS greatest
           FROM (SELECT k, place, n, sqrt(sum(n * n) OVER (PARTITION BY k)) AS size
                 FROM (SELECT k, place, CAST(sum(n) AS DOUBLE) AS n FROM counted JOIN placed USING (token) GROUP BY k, place) AS c) AS v GROUP BY k""",
        "cases",
        counted=f"SELECT k, token, count(*) AS n FROM (SELECT k, unnest(regexp_extract_all({HASH_TEXT}, '\\b\\S+\\b')) AS token FROM cases) AS t GROUP BY k, token",
        **MURMUR3,
    ),
    "snk_model": with_parts("SELECT split, label_serious AS label, count(*) AS n, CAST(0 AS BIGINT) AS differing FROM split_cases GROUP BY ALL", "split_cases"),
}
ORACLE["snk_reports"] = ORACLE["agg_coverage"]
