"""Queries over single reads by the library's own functions and operators; their SQL in plans.sql is the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import dna
from strandloom.operators import alignment, libraries
from strandloom.plans.views import K
from strandloom.streaming.counts import kmer_counts

#: Bases that a read must keep, and those that reads of one length are cut to.
LEAST, TRIM = K + 10, 90


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandloom.plans.catalog import run_sql

    return run_sql(spark, sf_dir, "SELECT read_id, lib_id, i, seq, seq_n FROM reads")


def base_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir).select("read_id", dna.encode(F.col("seq")).alias("digits"))


def base_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base_encode(spark, sf_dir).select("read_id", dna.decode(F.col("digits")).alias("seq"))


def revcomp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir).select("read_id", dna.revcomp(F.col("seq")).alias("rc"))


def complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir).select("read_id", dna.complement(F.col("seq")).alias("comp"))


def both_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.strands(_reads(spark, sf_dir))


def kmer_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reads(spark, sf_dir).select("read_id", F.posexplode(dna.windows(F.col("seq"), K + 1)).alias("at", "kp1")).select("read_id", (F.col("at") + 1).alias("p"), "kp1")


def canonical_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_windows(spark, sf_dir).select("read_id", "p", dna.canonical(F.col("kp1")).alias("canon"))


def kmer_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_counts(_reads(spark, sf_dir), K + 1).select("kp1", F.least("n", F.lit(255)).cast("int").alias("freq"))


def solid_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_count(spark, sf_dir).where("freq >= 2")


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest part of each read without N."""
    found = _reads(spark, sf_dir).withColumn("r", libraries.region(F.col("seq_n")))
    return found.select("read_id", "lib_id", F.col("r.start").alias("start"), F.col("r.len").alias("len"), F.expr("substr(seq_n, r.start + 1, r.len)").alias("region"))


def n_free_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).select("read_id", "start", "len", "region")


def filter_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).where(F.col("len") >= LEAST).select("read_id", "len")


def trim_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).where(F.col("len") >= TRIM).select("read_id", F.substring("region", 1, TRIM).alias("seq"))


def read_len_extrema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _regions(spark, sf_dir).agg(F.min("len").alias("min_len"), F.max("len").alias("max_len"))


def read_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = F.col("len") >= LEAST
    return _regions(spark, sf_dir).groupBy("lib_id").agg(F.count_if(passed).alias("processed"), F.count_if(~passed).alias("unprocessed"))


def queries() -> dict:
    return {f.__name__: f for f in (base_encode, base_decode, revcomp, complement, both_strands, kmer_windows, canonical_kmer, kmer_count, solid_kmers, n_free_region, filter_len, trim_fixed, read_len_extrema, read_tally)}
