"""A training corpus from the documents table, in five stages.

Each stage's result is written as Parquet and read again as the next one's
documents. All but the last keep the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusforge.llm._common import materialise, table
from corpusforge.llm.decontaminate import decontaminate
from corpusforge.llm.near_dedup import drop_near_duplicates
from corpusforge.llm.packing import pack_documents
from corpusforge.llm.quality import quality_filter
from corpusforge.llm.secrets import redact_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents that the rules reject go.

    Null and empty texts are rejected; repeated rows are judged alike. Without
    labels of both kinds nothing else is. An empty table gives an empty one.
    """
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: one document of each group of near copies stays.

    Of repeated rows one stays; rows without words are in no group and stay; of
    equal doc_ids the least text, null doc_ids last.
    """
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that hold a benchmark item go.

    Null and empty texts hold none; repeated rows stay or go together; items
    that are null or have no word are not looked for.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: secrets are replaced in the text; all documents stay.

    Null texts stay null, repeated rows stay; n_chars follows the text.
    """
    return redact_secrets(docs, path="source")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: the places of the documents' tokens in training sequences.

    Null and empty texts have no token and no place; repeated rows and null
    doc_ids have one each.
    """
    return pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Forest scores, MinHash groups and greedy packing are beyond SQL; the tests
#: hold each stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
