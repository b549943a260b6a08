"""From raw documents to packed training sequences: five stages, each written and read again by the next.

1. toxicity: documents that the nearest labelled examples call toxic go.
2. quality: documents that the discriminant calls low in quality go.
3. near_duplicates: one document of each group of near copies stays (five words, 80 per cent).
4. mixing: sources are mixed to target weights; a document taken twice has two rows, and none is cut.
5. packing: tokens of every row get their places in sequences.

All stages but the last return the columns of ``documents``. Null and empty texts, repeated rows and further columns are
dealt with as each operator's docstring says; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepwell.llm.common import DOCUMENT_COLUMNS, read, tokenizer_file
from keepwell.llm.minhash import near_duplicates
from keepwell.llm.mixing import mixed_documents
from keepwell.llm.packing import pack_documents
from keepwell.llm.quality_classifier import score_quality
from keepwell.llm.scoring import remainder_is
from keepwell.llm.toxicity import score_toxicity
from keepwell.session import materialize


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = ~remainder_is(F.col("doc_id"), 3, 1)
    scored = score_toxicity(docs, read(spark, sf_dir, "labels"), known, DOCUMENT_COLUMNS)
    return scored.filter("predicted = 0").select(*DOCUMENT_COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    known = ~remainder_is(F.col("doc_id"), 5, 0)
    scored = score_quality(docs, read(spark, sf_dir, "labels"), known, DOCUMENT_COLUMNS)
    return scored.filter("predicted = 1").select(*DOCUMENT_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = [c for c in DOCUMENT_COLUMNS if c not in ("doc_id", "text")]
    return near_duplicates(docs, keep=others).filter("first").select(*DOCUMENT_COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_documents(docs, whole=True).select(*DOCUMENT_COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("quality", quality),
    ("near_duplicates", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: Scores learned from labels, hashed minima and tokens are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
