"""A corpus pipeline of the operators in ``logloom.llm``: each stage reads what the one before kept.

Quality rules drop the documents they reject, the n-gram Jaccard join (five words, similarity
0.8) keeps one document of each group, secret scans mask what they find, and best-fit packing
lays the rest into sequences. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm import ngram_join, packing, rule_quality, secret_scan
from logloom.llm.queries import BYTE_BPE
from logloom.session import prepare, stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the fixed rules or the forest reject go."""
    prepare(spark)
    return rule_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the smallest id stays."""
    prepare(spark)
    return ngram_join.keep_one(docs, words=5, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are masked and ``n_chars`` follows the text."""
    prepare(spark)
    masked = secret_scan.redact_secrets(docs)
    if "n_chars" not in masked.columns:
        return masked
    kind = dict(masked.dtypes)["n_chars"]
    return masked.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), "n_chars"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document with their sequence and place."""
    prepare(spark)
    packed = packing.pack(packing.pieces(docs, BYTE_BPE))
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("secret scans", secret_stage),
    ("best-fit packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``, each one written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
