"""Corpus pipeline: quality rules, near duplicates, personal data, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its result is
written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stridefield.llm import curriculum, host_rules, lsh_forest, pii, unigram
from stridefield.llm.storage import Scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
ORACLE_SQL = None
_open: list[Scratch] = []


def fresh(spark: SparkSession) -> Scratch:
    """A scratch folder for the stage that begins. The last stage's goes: its result has been written by then."""
    while _open:
        _open.pop().remove()
    _open.append(Scratch(spark))
    return _open[-1]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass their own rules and whose host passes."""
    # written once: a filter on the verdict would otherwise be pushed below the counts and repeat their expressions
    counted = fresh(spark).keep(host_rules.rule_counts(docs.select(*COLUMNS)).select(*COLUMNS, "base_failed", *host_rules.RULES))
    return host_rules.judge(counted).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class: the least doc_id (null last), then the first such row; ids may repeat."""
    return lsh_forest.keep_one(docs.select(*COLUMNS), fresh(spark))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found spans replaced by their kind; n_chars follows the new text."""
    return pii.redact(docs.select(*COLUMNS), fresh(spark)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, once for each pass that takes them, range-sorted by training position.

    Rows of a null or repeated doc_id are documents of their own, taken at most twice each like all others.
    """
    rows = fresh(spark).keep(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    mixed = curriculum.mix(curriculum.narrow(rows, "_row"), whole=True)
    placed = mixed.select("_row", F.explode("positions").alias("_position"))
    return rows.join(placed, "_row").repartitionByRange("_position", "doc_id").sortWithinPartitions("_position", "doc_id").select(*COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    fresh(spark)
    return unigram.encode_documents(docs.select(*COLUMNS))


STAGES = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("sentencepiece", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. A stage's table is removed once the next one is written; the last one is left."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = Scratch(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = tables.keep(stage(spark, docs, sf_dir))
        tables.remove(k)
    fresh(spark)
    return docs
