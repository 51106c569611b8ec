"""Report-shaped tables from order tables: plain SQL that Spark and other engines read alike.

There is no report data among the given tables. Orders stand for reports, their lines for drugs, the suppliers of the
lines for reactions, so every query below runs over whole given tables and grows with them.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_YEAR_QUARTER = "concat(CAST(year({d}) AS STRING), 'Q', CAST(quarter({d}) AS STRING))"
_DAY = "CAST(year({d}) * 10000 + month({d}) * 100 + day({d}) AS STRING)"
_Q = _YEAR_QUARTER.format(d="o_orderdate")

REACTION_NAMES = (
    "Death",
    "Cardiac arrest",
    "Headache",
    "Nausea",
    "  rash / itching ",
    "Fatal overdose",
    "Dizziness",
    "Fever",
    "Vomiting",
    "---",
    "Drug ineffective",
    "Pain (chest)",
)
_REACTION = "CASE k % 12 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(REACTION_NAMES)) + " END"

#: {orders} and so on stand for the given tables.
HEADERS = f"""
SELECT o_orderkey AS k,
       {_Q} AS quarter,
       concat('part', CAST(o_orderkey % 3 AS STRING), '.xml') AS source_file,
       CASE WHEN o_orderkey % 103 = 0 THEN '' WHEN o_orderkey % 101 = 0 THEN concat('US-', CAST(o_orderkey AS STRING))
            WHEN o_orderkey % 97 = 0 THEN concat('  ', CAST(o_orderkey AS STRING), ' ') ELSE CAST(o_orderkey AS STRING) END AS safetyreportid,
       CAST(o_orderkey % 3 + 1 AS STRING) AS safetyreportversion,
       CASE WHEN o_orderkey % 53 = 0 THEN 'bad' WHEN o_orderkey % 59 = 0 THEN '' WHEN o_orderkey % 61 = 0 THEN '20250231'
            ELSE {_DAY.format(d="o_orderdate")} END AS receivedate,
       {_DAY.format(d="o_orderdate")} AS receiptdate,
       CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE {_DAY.format(d="o_orderdate")} END AS transmissiondate,
       CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE n_name END AS primarysourcecountry,
       n_name AS occurcountry,
       CAST(o_orderkey % 4 + 1 AS STRING) AS reporttype,
       CAST(o_orderkey % 2 + 1 AS STRING) AS fulfillexpeditecriteria,
       CASE WHEN o_orderkey % 17 = 0 THEN '1' ELSE '' END AS duplicate,
       CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '2' END AS serious,
       CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0 THEN '1' ELSE '2' END AS seriousnessdeath,
       '2' AS seriousnesslifethreatening,
       CASE WHEN o_orderkey % 29 = 0 THEN ' 1 ' ELSE '' END AS seriousnesshospitalization,
       CASE WHEN o_orderkey % 31 = 0 THEN '1' ELSE '2' END AS seriousnessdisabling,
       '2' AS seriousnesscongenitalanomali,
       CASE WHEN o_orderkey % 37 = 0 THEN '1' ELSE '' END AS seriousnessother,
       CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE n_name END AS reportercountry,
       CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE CAST(o_orderkey % 5 + 1 AS STRING) END AS qualification,
       CAST(o_custkey % 3 + 1 AS STRING) AS sendertype,
       CASE WHEN o_orderkey % 41 = 0 THEN 'nan' WHEN o_orderkey % 43 = 0 THEN '-4' ELSE CAST(o_custkey % 97 AS STRING) END AS patientonsetage,
       CASE WHEN o_orderkey % 8 = 7 THEN '' WHEN o_orderkey % 16 = 0 THEN '800' WHEN o_orderkey % 16 = 8 THEN '802'
            WHEN o_orderkey % 16 IN (3, 5) THEN concat('80', CAST(3 + o_custkey % 4 AS STRING)) ELSE '801' END AS patientonsetageunit,
       CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE CAST(o_orderkey % 2 + 1 AS STRING) END AS patientsex,
       CASE WHEN o_orderkey % 9 < 6 THEN '' ELSE CAST(o_orderkey % 9 AS STRING) END AS patientagegroup,
       CASE WHEN o_orderkey % 5 <> 0 THEN '' WHEN o_orderkey % 10 = 0 THEN concat('1,', CAST(100 + o_custkey % 150 AS STRING))
            ELSE concat(CAST(o_custkey % 150 AS STRING), '.5 kg') END AS patientweight,
       o_totalprice AS price
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
"""

DRUGS = f"""
SELECT l_orderkey AS k,
       CASE l_returnflag WHEN 'A' THEN '1' WHEN 'N' THEN '2' ELSE '3' END AS drugcharacterization,
       CASE WHEN l_partkey % 23 = 0 THEN '' ELSE concat(p_name, ' / ', p_brand) END AS medicinalproduct,
       CASE WHEN l_partkey % 9 = 0 THEN 'unknown' WHEN l_partkey % 7 = 0 THEN concat(' ', CAST(CAST(l_quantity AS BIGINT) AS STRING), ' mg')
            WHEN l_partkey % 11 = 0 THEN concat('1,', CAST(100 + CAST(l_quantity AS BIGINT) AS STRING))
            ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END AS drugstructuredosagenumb,
       CASE WHEN l_partkey % 6 = 0 THEN '' ELSE {_DAY.format(d="o_orderdate")} END AS drugstartdate,
       CASE WHEN l_partkey % 10 = 0 THEN 'soon' ELSE {_DAY.format(d="l_shipdate")} END AS drugenddate,
       CASE WHEN l_partkey % 27 = 0 THEN '--' WHEN l_partkey % 4 = 0 THEN '' ELSE concat(p_type, ' condition') END AS drugindication,
       CASE WHEN l_partkey % 33 = 0 THEN '?' ELSE concat('by ', l_linestatus) END AS drugadministrationroute,
       CASE WHEN l_partkey % 3 = 0 THEN '' ELSE CAST(l_partkey % 5 AS STRING) END AS actiondrug,
       CASE WHEN l_partkey % 10 < 8 THEN p_type ELSE '' END AS substance
FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{orders}} ON l_orderkey = o_orderkey
"""

REACTIONS = f"""
SELECT key AS k, {_REACTION.replace("k % 12", "code")} AS reactionmeddrapt, CASE WHEN code % 4 = 0 THEN '' ELSE CAST(code % 4 AS STRING) END AS reactionoutcome
FROM (SELECT DISTINCT l_orderkey AS key, CAST(l_suppkey % 12 AS INT) AS code FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey) AS seen
"""

DELETED = f"""
SELECT {_Q} AS quarter, CAST(o_orderkey AS STRING) AS safetyreportid FROM {{orders}} WHERE o_orderkey % 211 = 0 OR o_orderkey % 103 = 0
"""

SCORES = f"""
SELECT o_orderkey AS k, model, CAST(o_orderkey AS STRING) AS safetyreportid,
       {_Q} AS quarter,
       CASE WHEN quarter(o_orderdate) <= 3 THEN 'train' WHEN o_orderkey % 2 = 0 THEN 'valid' ELSE 'test' END AS split,
       CASE WHEN o_orderkey % 6 = 0 THEN '' ELSE CAST(o_orderkey % 2 + 1 AS STRING) END AS patientsex,
       CASE WHEN o_orderkey % 8 = 7 THEN NULL ELSE CAST(o_custkey % 97 AS DOUBLE) END AS age_years,
       CASE WHEN o_orderstatus = 'F' OR (o_orderpriority = '1-URGENT' AND o_orderkey % 3 = 0) THEN 1 ELSE 0 END AS label,
       CASE WHEN model = 'price' THEN CAST(floor(o_totalprice / 5000) AS DOUBLE) / 128
            ELSE CAST((o_orderkey * 7919 + o_custkey * 31 + CASE WHEN o_orderstatus = 'F' THEN 40000 ELSE 0 END) % 65536 AS DOUBLE) / 65536 END AS score
FROM {{orders}} CROSS JOIN (SELECT 'price' AS model UNION ALL SELECT 'hash' AS model) AS models
"""

TABLES = ("orders", "customer", "nation", "lineitem", "part")


@cache
def plain(sql: str) -> str:
    """sql over tables of the given names."""
    return sql.format(**{t: t for t in TABLES})


#: The report's key in the tables that are large.
DEALT_BY = {"orders": "o_orderkey", "lineitem": "l_orderkey"}


def frame(spark: SparkSession, sf_dir: str, sql: str, dealt: bool = False) -> DataFrame:
    """dealt: the large tables are shuffled by key before anything is made of them, so that joins and sums by key shuffle no texts."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **{t: df.repartition(DEALT_BY[t]) if dealt and t in DEALT_BY else df for t, df in used.items()})


def headers(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return frame(spark, sf_dir, HEADERS, dealt)


def drugs(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """One row for each drug; activesubstance holds an empty name before the real one, which the rules must skip."""
    rows = frame(spark, sf_dir, DRUGS, dealt)
    return rows.withColumn("activesubstance", F.array(F.lit(" - "), F.col("substance"))).drop("substance")


def reactions(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    return frame(spark, sf_dir, REACTIONS, dealt)


def deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, DELETED)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame(spark, sf_dir, SCORES)
