"""A training corpus in five stages: toxic documents go, one document of each near-duplicate group
stays, repeated passages go, secrets are masked, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricewright.llm import near_dedup, packing, repeats, secret_scan, toxicity
from pricewright.llm.common import table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, with the length of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def toxic_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go; a document without text stays."""
    model = toxicity.learned(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(*COLUMNS), model, keep=COLUMNS)
    return scored.where("score < 0.5 OR text IS NULL").select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of least id stays; of equal rows, one. Groups without any id keep one too."""
    return near_dedup.one_of_each(docs, COLUMNS)


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere too go."""
    return _columns(repeats.without_repeats(docs, keep=("lang", "source")))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind in angle brackets."""
    return _columns(secret_scan.redact(docs, keep=("lang", "source")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, as pieces: document, place, ids and their checksum, sequence and offset."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxic_stage),
    ("near_dedup", near_stage),
    ("suffix_dedup", repeats_stage),
    ("secret_scan", secrets_stage),
    ("packing", packing_stage),
]

#: Classification, suffix sorting and packing are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
