"""Counts of (K+1)-mers over a stream of reads: each micro-batch is counted on its own and the counts add up when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.functions.dna import canonical, windows
from strandloom.plans.views import K


def kmer_counts(reads: DataFrame, size: int = K + 1) -> DataFrame:
    """(kp1, n) of canonical windows within reads (seq); reads that are null or shorter have none."""
    return reads.select(F.explode(windows(F.col("seq"), size)).alias("w")).groupBy(canonical(F.col("w")).alias("kp1")).agg(F.count(F.lit(1)).alias("n"))


def ingest(reads: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Starts counting a stream of reads (seq) into the folder out. A repeated batch replaces its own counts, so each counts once."""

    def write(batch: DataFrame, batch_id: int) -> None:
        kmer_counts(batch).write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={batch_id}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """(kp1, n) over all batches so far."""
    return spark.read.schema("kp1 string, n long").parquet(f"{out.rstrip('/')}/batch=*").groupBy("kp1").agg(F.sum("n").alias("n"))
