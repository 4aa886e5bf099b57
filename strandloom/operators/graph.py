"""Operators on the assembly graph: segments, tips, bubbles, vertices with links, variant texts and the way of reads through it.

The graph is a table of canonical edges (kp1, freq), (K+1)-mers with their counts; nodes are K-mers. Segments are unbranched
paths in both orientations. Clipping removes all edges of a segment at once, on both strands: what is judged is judged on
the graph as it came in, so results don't depend on an order of nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.dna import canonical, encode, revcomp
from strandloom.plans.iterative import _kept, oriented, ranked
from strandloom.plans.views import K

#: Mean frequency and share of the better branch up to which a segment counts as an error.
ERROR_FREQ, ERROR_SHARE = 2, 5
#: Bases in which the branches of a variant may differ.
VARIANT = 7


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    ranks: DataFrame
    segments: DataFrame
    k: int = K


def node_table(edges: DataFrame, k: int = K) -> DataFrame:
    """(kmer, freq, n_in, n_out) of oriented K-mers; an edge that is its own reverse complement counts twice, as on two strands."""
    both = oriented(edges, k).withColumn("w", F.when(F.col("kp1") == revcomp(F.col("kp1")), 2 * F.col("freq")).otherwise(F.col("freq")))
    ends = both.select(F.col("a").alias("kmer"), "w", F.lit(0).alias("i"), F.lit(1).alias("o")).union(both.select("b", "w", F.lit(1), F.lit(0)))
    raw = F.least(2 * F.sum("w"), F.lit(255))
    freq = F.when(raw > 4, F.floor((raw + 1) / 4)).otherwise(1)
    return ends.groupBy("kmer").agg(freq.cast("int").alias("freq"), F.sum("i").cast("int").alias("n_in"), F.sum("o").cast("int").alias("n_out"))


def seeds(nodes: DataFrame, peak: int) -> DataFrame:
    """(kmer, freq) of unbranched nodes, one strand each, whose frequency is near the peak: a unitig is walked from such."""
    near = (F.abs(F.col("freq") - peak) < 0.3 * peak) & (F.col("n_in") == 1) & (F.col("n_out") == 1)
    return nodes.where(near & (encode(F.col("kmer")) <= encode(revcomp(F.col("kmer"))))).select("kmer", "freq")


def roots(nodes: DataFrame, valley: int, peak: int) -> DataFrame:
    """(kmer, freq) of branching nodes, one strand each, between the valley and twice the peak: bubbles are sought from such."""
    within = (F.col("freq") > valley) & (F.col("freq") < 2 * peak) & ((F.col("n_in") > 1) | (F.col("n_out") > 1))
    return nodes.where(within & (encode(F.col("kmer")) <= encode(revcomp(F.col("kmer"))))).select("kmer", "freq")


def build(edges: DataFrame, k: int = K) -> Graph:
    """Segments (head, start, end, n, mean_freq, seq, freqs, start_*, end_*); n counts the nodes after the first, the last included."""
    ranks, nodes = _kept(ranked(edges, k)), _kept(node_table(edges, k))
    steps = ranks.join(nodes.select("kmer", F.col("freq").alias("f")), F.substring("kp1", 2, k) == F.col("kmer"))
    paths = steps.groupBy(F.col("root").alias("head")).agg(F.count(F.lit(1)).alias("n"), F.sum("f").alias("total"), F.sort_array(F.collect_list(F.struct("dist", F.substring("kp1", k + 1, 1).alias("c"), "f"))).alias("path"))
    seq = F.concat(F.substring("head", 1, k), F.array_join(F.transform("path", lambda x: x["c"]), ""))
    paths = paths.select("head", "n", F.floor(F.col("total") / F.col("n")).alias("mean_freq"), seq.alias("seq"), F.transform("path", lambda x: x["f"]).alias("later"))
    paths = paths.withColumn("start", F.substring("seq", 1, k)).withColumn("end", F.expr(f"right(seq, {k})"))
    side = lambda s: nodes.select(F.col("kmer").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in ("freq", "n_in", "n_out")))
    found = paths.join(side("start"), "start").join(side("end"), "end").withColumn("freqs", F.concat(F.array("start_freq"), "later")).drop("later")
    return Graph(edges, ranks, _kept(found), k)


def segment_table(g: Graph) -> DataFrame:
    """(seq, n, mean_freq, end_state): state 4 where nothing follows the last node, else 3, a branch."""
    return g.segments.select("seq", "n", "mean_freq", F.when(F.col("end_n_out") == 0, 4).otherwise(3).alias("end_state"))


def tips(g: Graph) -> DataFrame:
    """Segments from a branching node that are weak and shorter than 2K nodes, or that end within K nodes."""
    s = g.segments.where("start_n_in > 1 or start_n_out > 1")
    return s.where(((F.col("mean_freq") <= ERROR_FREQ) & (F.col("n") < 2 * g.k)) | ((F.col("n") <= g.k) & (F.col("end_n_out") == 0)))


def bubbles(g: Graph, valley: int, peak: int) -> DataFrame:
    """Weak segments beside a strong one with the same ends, from a branching node between valley and twice the peak.

    A node has four ways out at most, so the join pairs a segment with three others at most.
    """
    roots = g.segments.where((F.col("start_freq") > valley) & (F.col("start_freq") < 2 * peak) & (F.col("start_n_out") > 1))
    strong = roots.where(F.col("mean_freq") > valley).groupBy("start", "end").agg(F.max("mean_freq").alias("best"))
    weak = roots.where(F.col("mean_freq") <= ERROR_FREQ)
    return weak.join(strong, ["start", "end"]).where(F.col("mean_freq") * ERROR_SHARE <= F.col("best"))


def without(g: Graph, bad: DataFrame) -> DataFrame:
    """The edges of a graph but those of some of its segments."""
    gone = g.ranks.join(bad.select(F.col("head").alias("root")).distinct(), "root", "left_semi").select(canonical(F.col("kp1")).alias("kp1")).distinct()
    return g.edges.join(gone, "kp1", "left_anti")


def simplify(edges: DataFrame, valley: int, peak: int, k: int = K) -> Graph:
    """The graph after its tips, and then its bubbles, are gone."""
    clipped = build(_kept(without(g := build(edges, k), tips(g))), k)
    return build(_kept(without(clipped, bubbles(clipped, valley, peak))), k)


def vertices(g: Graph) -> DataFrame:
    """(id, seq, len, indegree, outdegree, freqs), one strand of each segment; the id is a digest of the sequence."""
    one = g.segments.where(encode(F.col("seq")) <= encode(revcomp(F.col("seq"))))
    return one.select(F.sha1("seq").alias("id"), "seq", F.length("seq").alias("len"), F.col("start_n_in").alias("indegree"), F.col("end_n_out").alias("outdegree"), "freqs")


def links(g: Graph) -> DataFrame:
    """(src, side, dst, strand): vertices that follow (r) or precede (l) a vertex, and the strand in which they do."""
    named = g.segments.select(F.sha1(canonical(F.col("seq"))).alias("id"), F.when(encode(F.col("seq")) <= encode(revcomp(F.col("seq"))), "+").otherwise("-").alias("strand"), "start", "end")
    src = named.where("strand = '+'").select(F.col("id").alias("src"), "start", "end")
    near = named.select(F.col("id").alias("dst"), "strand", F.col("start").alias("s"), F.col("end").alias("e"))
    after = src.join(near, src["end"] == near["s"]).select("src", F.lit("r").alias("side"), "dst", "strand")
    before = src.join(near, src["start"] == near["e"]).select("src", F.lit("l").alias("side"), "dst", "strand")
    return after.union(before).distinct()


def vertex_text(g: Graph) -> DataFrame:
    """Vertices as text records: >id, length and degrees; sequence; +; frequencies."""
    v = vertices(g)
    top = F.concat(F.lit(">"), F.concat_ws("\t", "id", F.col("len").cast("string"), F.col("indegree").cast("string"), F.col("outdegree").cast("string")))
    return v.select(F.concat_ws("\n", top, "seq", F.lit("+"), F.array_join(F.col("freqs").cast("array<string>"), " ")).alias("record"))


def edge_text(g: Graph) -> DataFrame:
    """Links as text lines: id, neighbours to the left, neighbours to the right, each followed by a colon."""
    of = lambda s: F.array_join(F.transform(F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("dst")))), lambda x: F.concat(x, F.lit(":"))), "")
    return links(g).groupBy("src").agg(of("l").alias("l"), of("r").alias("r")).select(F.concat_ws("\t", "src", "l", "r").alias("line"))


def self_cycles(g: Graph, reads: DataFrame, least: int) -> DataFrame:
    """(id, seq, support): vertices with two ways in and out, one of them to itself, that at least `least` reads (seq) run through whole.

    A read runs through where it holds the vertex with a base before and a base after it.
    """
    loops = vertices(g).join(links(g).where("side = 'r' and strand = '+' and src = dst").select(F.col("src").alias("id")), "id", "left_semi").where("indegree = 2 and outdegree = 2").select("id", "seq")
    both = reads.select("seq").union(reads.select(revcomp(F.col("seq")))).withColumnRenamed("seq", "read").where(F.length("read") > g.k + 1)
    at = both.select("read", F.explode(F.sequence(F.lit(2), F.length("read") - g.k)).alias("p")).withColumn("seed", F.expr(f"substr(read, p, {g.k})"))
    hits = loops.withColumn("seed", F.substring("seq", 1, g.k)).join(at, "seed").where("substr(read, p, length(seq)) = seq and p + length(seq) <= length(read)")
    return hits.groupBy("id", "seq").agg(F.count(F.lit(1)).alias("support")).where(F.col("support") >= least)


def variants(g: Graph) -> DataFrame:
    """(text, n_alts): branches with the same ends that differ in a few leading bases, as start{a,b}end; one strand of each."""
    alt = F.expr(f"substr(seq, {g.k + 1}, length(seq) - {2 * g.k})")
    s = g.segments.where((F.length("seq") > 2 * g.k) & (F.length("seq") <= 2 * g.k + VARIANT)).withColumn("alt", alt)
    found = s.groupBy("start", "end").agg(F.array_sort(F.collect_set("alt")).alias("alts")).where("size(alts) > 1")
    one = found.where(encode(F.concat("start", "end")) <= encode(revcomp(F.concat("start", "end"))))
    return one.select(F.concat("start", F.lit("{"), F.array_join("alts", ","), F.lit("}"), "end").alias("text"), F.size("alts").alias("n_alts"))


def expand(text: Column) -> Column:
    """Every sequence that a text with {a,b} stands for."""
    return F.aggregate(F.split(text, "[{}]"), F.array(F.lit("")), lambda done, part: F.flatten(F.transform(done, lambda d: F.transform(F.split(part, ","), lambda x: F.concat(d, x)))))


def text_quality(text: Column) -> Column:
    """A quality for each base of the first reading: 3, or 2 within a variant."""
    return F.array_join(F.transform(F.split(text, "[{}]"), lambda part, i: F.repeat(F.when(i % 2 == 0, "3").otherwise("2"), F.length(F.element_at(F.split(part, ","), 1)))), "")


def read_paths(g: Graph, reads: DataFrame) -> DataFrame:
    """(read_id, strand, start, path, map_len) of reads (read_id, seq) that lie in the graph whole: the vertices in their order.

    Each (K+1)-mer of a read is looked up once; a read whose every (K+1)-mer is an edge is a walk, since neighbours share a node.
    start is the place of the read's first base in its first segment.
    """
    both = reads.select("read_id", F.lit("+").alias("strand"), "seq").union(reads.select("read_id", F.lit("-"), revcomp(F.col("seq")))).where(F.length("seq") > g.k)
    at = both.select("read_id", "strand", F.length("seq").alias("len"), F.explode(F.sequence(F.lit(1), F.length("seq") - g.k)).alias("p"), "seq").withColumn("kp1", F.expr(f"substr(seq, p, {g.k + 1})"))
    ids = g.segments.select(F.col("head").alias("root"), F.sha1(canonical(F.col("seq"))).alias("id"))
    # a table of K-mers compresses so well that its size on disk says little: never broadcast it
    hits = at.drop("seq").join(g.ranks.join(ids, "root").hint("merge"), "kp1").groupBy("read_id", "strand", "len").agg(F.sort_array(F.collect_list(F.struct("p", "dist", "id"))).alias("way")).where(F.size("way") == F.col("len") - g.k)
    # a vertex begins where the read enters a segment: at its first base and wherever a segment's first edge is
    path = F.transform(F.filter("way", lambda x: (x["p"] == 1) | (x["dist"] == 0)), lambda x: x["id"])
    return hits.select("read_id", "strand", F.col("way")[0]["dist"].alias("start"), path.alias("path"), F.col("len").alias("map_len"))
