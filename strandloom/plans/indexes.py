"""Queries of the index over all derived reads, by the operators; their SQL in plans.sql is the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.dna import encode
from strandloom.operators import index as I  # noqa: E741
from strandloom.plans.iterative import _kept


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    from strandloom.plans.catalog import run_sql

    return run_sql(spark, sf_dir, text)


def _suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.suffixes(_sql(spark, sf_dir, "SELECT read_id AS rid, seq FROM reads"))


def _sa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.suffix_array(_suffixes(spark, sf_dir))


def suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sa(spark, sf_dir).select("isa", "rid", "off")


def bwt_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sa(spark, sf_dir).select("isa", "bwt")


def fm_occ(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.occurrences(_sa(spark, sf_dir))


def lf_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.last_to_first(fm_occ(spark, sf_dir))


def lcp_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.lcp_flags(_sa(spark, sf_dir))


def sa_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array(spark, sf_dir).where("isa % 64 = 0")


def bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column over two sets of reads together."""
    found = _kept(_suffixes(spark, sf_dir))
    return I.suffix_array(found.where("rid % 2 = 0").union(found.where("rid % 2 <> 0"))).select("isa", "bwt")


def vertex_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the nodes that end a segment, in the order of bases."""
    ends = _sql(spark, sf_dir, "SELECT kmer FROM nodes WHERE bit_count(llink) <> 1 OR bit_count(rlink) <> 1")
    return I.numbered(ends.withColumn("order", encode(F.col("kmer"))), "k", "order").select("kmer", "k")


def locate_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads that hold as many spread positions as there are reads."""
    reads = _kept(_sql(spark, sf_dir, "SELECT read_id, seq FROM reads"))
    laid = _kept(I.offsets(reads, "read_id", F.length("seq")))
    total, n = laid.agg(F.max("end"), F.count(F.lit(1))).first()
    return I.locate(spark.range(n).select((F.col("id") * 997 % F.lit(total or 1)).alias("pos")), laid, "read_id")


def doc_kmer_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.plans.catalog import spread

    return I.text_window_hist(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text")), 255)


def queries() -> dict:
    return {f.__name__: f for f in (suffix_array, bwt_column, fm_occ, lf_map, lcp_flag, sa_sample, bwt_merge, vertex_index, locate_read, doc_kmer_hist)}
