"""Queries over the assembly graph and scaffolds of the derived reads.

All (K+1)-mers, those seen once too, are edges here, so that substitutions in reads leave tips and bubbles to find. Valley
and peak are those of the reads' histogram at K = 33.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import alignment
from strandloom.operators import graph as G
from strandloom.operators import scaffold
from strandloom.plans.iterative import _kept
from strandloom.plans.iterative import unitigs as walked
from strandloom.plans.sql import SQL
from strandloom.sources.reads import libraries

VALLEY, PEAK = 3, 13
LIBRARIES = """[global_setting]
max_rd_len = 100
[LIB]
name = pairs
avg_insert_len = 300
insert_SD = 30
diverse_rd_len = 1
asm_flag = 3
seq_profile = 1
qual_benchmark = 33
f1 = pairs_1.fq.gz
f2 = pairs_2.fq.gz
[LIB]
name = singles
diverse_rd_len = 1
asm_flag = 1
seq_profile = 2
qual_benchmark = 33
sf1 = singles.fa
"""


def _sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    from strandloom.plans.catalog import run_sql

    return run_sql(spark, sf_dir, text)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_sql(spark, sf_dir, "SELECT kp1, CAST(least(n, 255) AS INT) AS freq FROM counts"))


def _reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(_sql(spark, sf_dir, "SELECT read_id, seq FROM reads"))


def _unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(unitigs(spark, sf_dir).select("id", "seq"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(G.vertices(G.build(edges(spark, sf_dir))).select("id", "seq"))


def _simple(spark: SparkSession, sf_dir: str) -> G.Graph:
    return G.simplify(edges(spark, sf_dir), VALLEY, PEAK)


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.segment_table(G.build(edges(spark, sf_dir)))


def tips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.tips(G.build(edges(spark, sf_dir))).select("seq", "n", "mean_freq")


def bubbles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.bubbles(G.build(edges(spark, sf_dir)), VALLEY, PEAK).select("seq", "n", "mean_freq", "best")


def unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.vertices(_simple(spark, sf_dir)).select("id", "seq", "len")


def dbg_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.links(G.build(edges(spark, sf_dir)))


def dbg_vertex_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.vertex_text(_simple(spark, sf_dir))


def dbg_edge_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edge_text(G.build(edges(spark, sf_dir)))


def self_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.self_cycles(G.build(edges(spark, sf_dir)), _reads(spark, sf_dir), 2)


def bubble_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.variants(G.build(edges(spark, sf_dir)))


def variant_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bubble_merge(spark, sf_dir).select("text", F.explode(G.expand(F.col("text"))).alias("seq"))


def unitig_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bubble_merge(spark, sf_dir).select("text", G.text_quality(F.col("text")).alias("quality"))


def map_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.read_paths(_simple(spark, sf_dir), _reads(spark, sf_dir))


def reads_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_reads(spark, sf_dir), _unitigs(spark, sf_dir))


def reads_map_gapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads lose a base (every third) or repeat one (every third again) first, as the derived reads have no gaps."""
    text = "SELECT read_id, CASE i % 3 WHEN 0 THEN concat(substr(seq, 1, 40), substr(seq, 42)) WHEN 1 THEN concat(substr(seq, 1, 60), substr(seq, 60)) ELSE seq END AS seq FROM reads"
    return alignment.align_gapped(_kept(_sql(spark, sf_dir, text)), _unitigs(spark, sf_dir))


def flank_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.flanks(alignment.flank_pairs(_reads(spark, sf_dir)), allowed=2).select("qid", "rid", "strand", "n_diff", "consis_len")


def flank_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.flank_pool(_reads(spark, sf_dir), _segments(spark, sf_dir))


def flank_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.extensions(flank_pool(spark, sf_dir))


def readsmap_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    mates = _sql(spark, sf_dir, "SELECT read_id, read_id - i % 2 AS pair_id, i % 2 + 1 AS mate FROM reads WHERE lib_id < 2")
    return alignment.mapped_groups(_kept(reads_map(spark, sf_dir)), mates)


def lib_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The libraries of a library file with one library of each kind."""
    return libraries(spark, LIBRARIES)


def scaffold_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold.order(_kept(_sql(spark, sf_dir, SQL["gap_estimate"])))


def scaffold_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaffold.sequences(scaffold_order(spark, sf_dir), _sql(spark, sf_dir, "SELECT doc_id AS unitig, g AS seq FROM genomes"))


def unitig_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.seeds(G.node_table(edges(spark, sf_dir)), PEAK)


def simplify_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.roots(G.node_table(edges(spark, sf_dir)), VALLEY, PEAK)


def _solid_unitigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walked(_kept(_sql(spark, sf_dir, "SELECT kp1, freq FROM solid")))


def segment_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes and mean frequency of each unitig of the solid graph."""
    return _solid_unitigs(spark, sf_dir).select(F.sha1("seq").alias("id"), "n_kmers", "mean_freq")


def map_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads that start within unitigs of the solid graph."""
    targets = _kept(_solid_unitigs(spark, sf_dir).select(F.sha1("seq").alias("id"), "seq"))
    return alignment.seed_hits(_reads(spark, sf_dir).select(F.col("read_id").alias("rid"), "seq"), targets)


def queries() -> dict:
    return {f.__name__: f for f in (unitig_seeds, simplify_roots, segment_stats, map_seed, segments, tips, bubbles, unitigs, dbg_links, dbg_vertex_text, dbg_edge_text, self_cycles, bubble_merge, variant_expand, unitig_quality, map_paths, reads_map, reads_map_gapped, flank_align, flank_pool, flank_extend, readsmap_groups, lib_config, scaffold_order, scaffold_seq)}
