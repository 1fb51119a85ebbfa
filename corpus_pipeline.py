"""The corpus pipeline: five stages from documents to packed sequences.

Each stage is a function (spark, docs, sf_dir) -> DataFrame that works on every row its predecessor kept. All but the last
return the columns of documents. ``run`` applies them in order and writes each result as Parquet to the shared folder,
so that a lost executor costs at most the tasks of one stage. What a stage saved on its way is deleted after that.

Rows, in every stage: a null text is one without words (stage 1 rejects it), a null source or language is a value of its
own, a null doc_id is kept; rows that repeat a doc_id are documents of their own, told apart by their texts (stage 2 keeps
one of equal ones); ties go by doc_id and a hash of the text; an empty table gives an empty result; further columns are
kept by all stages but the last, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skyloom.llm import jaccard, mixing, packing, pii, quality
from skyloom.llm.storage import settled


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    return quality.good_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest doc_id, of each group linked by five-word shingles at a similarity of 0.8."""
    return jaccard.one_of_each_group(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data in its text replaced by its kind."""
    return pii.masked_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, length, bin, start) of every piece of every document."""
    return packing.packed_documents(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: SQL can express neither the robust estimates nor the packing; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), f"stage{k + 1}")
    return docs
