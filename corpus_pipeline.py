"""A corpus pipeline over documents: five stages, each written as Parquet and read again as the next one's input.

1. language ID: a model is fitted on the documents that have a language; documents without a letter, and those whose
   language it can't tell with a score of at least 0.5, go. A missing lang is filled in.
2. near-dedup: of each group of equal texts and of texts at a five-word similarity of 0.8 or more one document stays. SimHash
   pivot tables find links, which are verified; an exact join completes the groups.
3. benchmark decontamination: documents with a window that is similar to a benchmark item go.
4. secret scans: secrets are replaced by their kind; n_chars is the length of the new text.
5. best-fit packing: the rest is packed into sequences of 4096 tokens.

All but the last return the columns of documents. Each stage defines nulls, empty and very long texts, ties, repeated
rows, empty tables and further columns as its operator does: see the operators' modules. Rows go by their own number or
text, never by their id, so null and repeated ids take no other row with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm import decontaminate, langid, packing, secrets, simhash
from strandloom.llm.common import stored
from strandloom.llm.queries import table, vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_multi_50k.tiktoken")
    return langid.identified(docs, langid.fit(docs, F.lit(True), path), path)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicated(docs, words=5, radius=3)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, length_col="n_chars" if "n_chars" in docs.columns else None)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("best_fit_packing", best_fit_packing),
]
#: SQL can't express the first stage's model, the fingerprints and the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
