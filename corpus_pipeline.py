"""A corpus from raw documents to token ids, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's
documents. All but the last return the columns of ``documents``.

1. language ID: documents without a letter, or that no language claims, go.
2. near-duplicates: of each group the document with the smallest id stays.
3. PII: validated personal data becomes a format-preserving pseudonym in the text.
4. mixture: domains, languages and sources at their target weights; a document may come in several epochs,
   and then is several rows.
5. ids: SentencePiece ids of every text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from colgauge.llm.feistel_pii import pseudonymise
from colgauge.llm.odd_sketch import deduplicate
from colgauge.llm.sentencepieces import Pieces, encode
from colgauge.llm.string_kernel import keep_known
from colgauge.llm.weighted_mix import WEIGHTS, domain, mix
from colgauge.session import materialise


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicate(docs)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pseudonymise(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, [domain("source"), F.col("lang"), F.col("source")], WEIGHTS)


def ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``ids`` in place of the text, and ``n_tokens``, how many there are; columns so named before go."""
    return encode(docs.drop("ids", "n_tokens"), "text", "ids", Pieces.load()).withColumn("n_tokens", F.size("ids").cast("long")).drop("text")


STAGES = [("language_id", language), ("near_dedup", near_copies), ("pii", private), ("mixture", mixture), ("sentencepiece", ids)]
# The kernels of stage 1, the permutations of stage 3 and the merges of stage 5 are not for SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
