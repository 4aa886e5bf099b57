"""Graph queries that need rounds: unbranched paths by pointer doubling, groups of linked unitigs by smallest label."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.dna import encode, revcomp
from strandloom.plans.views import K


def _kept(df: DataFrame) -> DataFrame:
    """Writes a round's table to the shared folder, where a lost executor can't take it away."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        import tempfile

        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="strandloom-")
    path = f"{base.rstrip('/')}/round-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def oriented(edges: DataFrame, k: int = K) -> DataFrame:
    """(kp1, freq, a, b): each edge in both orientations, with the K-mers it leaves and enters."""
    both = edges.select("kp1", "freq").union(edges.select(revcomp(F.col("kp1")).alias("kp1"), "freq")).distinct()
    return both.select("kp1", "freq", F.substring("kp1", 1, k).alias("a"), F.substring("kp1", 2, k).alias("b"))


def ranked(edges: DataFrame, k: int = K) -> DataFrame:
    """(kp1, freq, root, dist): for each oriented edge of canonical edges (kp1, freq) the first edge of its path and the way from there.

    A path's edge is joined to the next where the K-mer between them has one edge in and one out. Ranks come from pointer
    doubling: each round, an edge's pointer becomes its target's and distances add up. Pure cycles have no first edge and
    no rows; rounds stop when no pointer moves or, as cycles never settle, after as many as the longest path can need.
    """
    both = oriented(edges, k)
    into, out = both.groupBy("b").agg(F.count(F.lit(1)).alias("n_in"), F.first("kp1").alias("prev")), both.groupBy("a").agg(F.count(F.lit(1)).alias("n_out"))
    simple = into.join(out, into["b"] == out["a"]).where("n_in = 1 and n_out = 1").select(F.col("b").alias("node"), "prev")
    state = _kept(both.join(simple, both["a"] == simple["node"], "left").select("kp1", "freq", "prev", F.col("prev").isNotNull().cast("long").alias("dist")).withColumn("root", F.coalesce("prev", "kp1")))
    rounds = max(1, state.count()).bit_length() + 1
    for _ in range(rounds):
        far = state.select(F.col("kp1").alias("k"), F.col("root").alias("r2"), F.col("dist").alias("d2"))
        after = _kept(state.join(far, state["root"] == far["k"]).select("kp1", "freq", "prev", F.col("r2").alias("root"), (F.col("dist") + F.col("d2")).alias("dist")))
        moving = after.agg(F.sum("dist")).first()[0] != state.agg(F.sum("dist")).first()[0]
        state = after
        if not moving:
            break
    heads = state.where("prev is null").select(F.col("kp1").alias("head"))
    return state.join(heads, state["root"] == heads["head"], "left_semi").select("kp1", "freq", "root", "dist")


def unitigs(edges: DataFrame) -> DataFrame:
    """(head, n_kmers, mean_freq, seq) of maximal unbranched paths over canonical solid edges (kp1, freq), one strand each."""
    state = ranked(edges).withColumnRenamed("root", "head")
    paths = state.groupBy("head").agg(F.count(F.lit(1)).alias("n_edges"), F.sum("freq").alias("total"), F.sort_array(F.collect_list(F.struct("dist", F.substring("kp1", K + 1, 1).alias("c")))).alias("path"))
    paths = paths.select("head", (F.col("n_edges") + 1).alias("n_kmers"), F.floor(F.col("total") / F.col("n_edges")).alias("mean_freq"), F.concat(F.substring("head", 1, K), F.array_join(F.transform("path", lambda x: x["c"]), "")).alias("seq"))
    return paths.where(encode(F.col("seq")) <= encode(revcomp(F.col("seq"))))


def groups(links: DataFrame) -> DataFrame:
    """(unitig, group_id) of unordered links (u1, u2): group_id is the smallest unitig in reach, whatever the type of unitigs.

    Each round, a unitig takes the least label around it and then that label's own; rounds end when no label changes.
    """
    both = _kept(links.select(F.col("u1").alias("u"), F.col("u2").alias("v")).union(links.select("u2", "u1")).distinct())
    labels = _kept(both.select(F.col("u").alias("unitig"), F.col("u").alias("group_id")).distinct())
    while True:
        near = both.join(labels, both["v"] == labels["unitig"]).groupBy("u").agg(F.min("group_id").alias("m"))
        low = labels.join(near, labels["unitig"] == near["u"]).select("unitig", F.col("group_id").alias("was"), F.least("group_id", "m").alias("group_id"))
        hop = low.select(F.col("unitig").alias("x"), F.col("group_id").alias("g2"))
        after = _kept(low.join(hop, low["group_id"] == hop["x"]).select("unitig", "was", F.least("group_id", "g2").alias("group_id")))
        labels = after.select("unitig", "group_id")
        if after.where("group_id <> was").isEmpty():
            return labels


def queries() -> dict:
    def edges(spark, sf_dir):
        from strandloom.plans.catalog import run_sql

        return _kept(run_sql(spark, sf_dir, "SELECT kp1, freq FROM solid"))

    def dbg_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
        return unitigs(edges(spark, sf_dir)).select("seq", "n_kmers", "mean_freq")

    def unitig_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
        return unitigs(edges(spark, sf_dir)).select(F.concat(F.lit(">"), F.sha1("seq"), F.lit("\t"), F.length("seq").cast("string"), F.lit("\n"), F.col("seq")).alias("record"))

    def unitig_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
        from strandloom.plans.catalog import run_sql

        return groups(run_sql(spark, sf_dir, "SELECT u1, u2 FROM links"))

    return {"dbg_vertices": dbg_vertices, "unitig_fasta": unitig_fasta, "unitig_groups": unitig_groups}
