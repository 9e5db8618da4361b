"""The corpus pipeline: raw documents to packed training sequences.

``STAGES`` lists (name, function) in order.  Each function takes
``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet
and reread as the next one's ``docs``; all but the last keep the columns of
``documents``.

1. quality_rules: documents that the repetition rules reject go;
2. near_duplicates: of each component of the n-gram Jaccard join one document
   stays, the one of the least doc_id;
3. decontamination: documents that hold a benchmark window go;
4. secret_scan: all documents stay, secrets are masked;
5. packing: the documents' ids are packed into training sequences.

Null or empty texts fail the quality rules.  Columns beyond those of
``documents`` pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from storelens.llm.catalog import tokenizer_path
from storelens.llm.common import table, written
from storelens.llm.decontaminate import remove_documents
from storelens.llm.packing import packed
from storelens.llm.repetition import filter_repetitive
from storelens.llm.secrets_markov import redact
from storelens.llm.vertical_jaccard import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return filter_repetitive(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Linked at five-word shingles and a similarity of 0.8 or more (``WORDS``, ``PERCENT``)."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return remove_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: The packing stage reads token ids, which SQL cannot make; tests hold the
#: pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
