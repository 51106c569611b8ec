"""A training corpus in five stages: quality, toxicity, near duplicates, mixing, packing.

Each stage works on all rows its predecessor kept; all but the last return the columns of documents. Ids are handed on as they are:
null and repeated ids are ids like any other. Rows are never told apart by their id alone. Other columns, whatever their names, are
carried along; an empty table stays empty. Stages bound the rows of a batch that the session sends to Python, as texts may be long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm import quality, toxicity
from casewright.llm.mixing import mix_documents
from casewright.llm.packing import pack_documents
from casewright.llm.queries import quality_model, toxicity_model
from casewright.llm.simhash import keep_one_per_group
from casewright.llm.tables import materialise, read_table, small_batches, whole_rows


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier takes for good. A null text is judged as an empty one; copies are judged alike."""
    small_batches(spark)
    scored = quality.score_quality(whole_rows(docs, "text"), quality_model(spark, sf_dir))
    return scored.where(F.col("score") >= quality.CUT).select("row.*")


def keep_harmless(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier passes. Null, empty and wordless texts score 0 and pass; copies are judged alike."""
    small_batches(spark)
    scored = toxicity.score_toxicity(whole_rows(docs, "text"), toxicity_model(spark, sf_dir))
    return scored.where(F.col("score") < toxicity.CUT).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near copies: five words, similarity 0.8 or more. SimHash, segment popcounts and the grid join find the
    nearest, exact tiles what fingerprints cannot tell; every link is settled on whole sets and none is lost.

    The smallest id of a group stays, a null one last; all texts without words, null ones among them, are one group."""
    small_batches(spark)
    return keep_one_per_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources meet their target words.

    Texts without words take none and stay once (twice in a source at its cap); a null source is a source of its own."""
    small_batches(spark)
    return mix_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, with their token ids, in training sequences. A null or empty text is its separator alone; copies are
    packed each on their own."""
    small_batches(spark)
    return pack_documents(docs)


STAGES = [
    ("quality", keep_good),
    ("toxicity", keep_harmless),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: No stage but packing's counting could be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    name, stage = STAGES[-1]
    return stage(spark, docs, sf_dir)
