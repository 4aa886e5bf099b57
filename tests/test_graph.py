import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_iterative import canon, rc

from strandloom.operators import graph as G
from strandloom.operators import scaffold as S
from strandloom.plans.views import K

RNG = random.Random(5)


def dna(n):
    return "".join(RNG.choice("ACGT") for _ in range(n))


def swap(s, at):
    return s[:at] + ("A" if s[at] != "A" else "C") + s[at + 1 :]


TEXT = dna(400)
TIP = TEXT[:150] + dna(20)
BUBBLE = swap(TEXT, 250)[200:300]
ENTRY, INNER = dna(K), dna(40)
LOOP = ENTRY + INNER + ENTRY
AROUND = dna(90) + LOOP + dna(90)


def kp1s(s):
    return [canon(s[i : i + K + 1]) for i in range(len(s) - K)]


@pytest.fixture(scope="module")
def graph(spark):
    n = Counter(x for s, times in ((TEXT, 20), (TIP[100:], 1), (BUBBLE, 1)) for _ in range(times) for x in kp1s(s))
    return G.build(spark.createDataFrame(sorted(n.items()), "kp1 string, freq int"))


def test_segments_hold_every_edge_on_both_strands(graph):
    got = Counter(x for r in graph.segments.collect() for x in (r.seq[i : i + K + 1] for i in range(len(r.seq) - K)))
    edges = {r.kp1 for r in graph.edges.collect()}
    assert got == Counter(edges | {rc(x) for x in edges})
    assert all(r.n == len(r.seq) - K and len(r.freqs) == r.n + 1 and r.mean_freq == sum(r.freqs[1:]) // r.n for r in graph.segments.collect())


def test_tip_and_bubble_are_found_and_go(graph):
    found = {canon(r.seq) for r in G.tips(graph).collect()}
    assert canon(TIP[150 - K :]) in found and canon(BUBBLE[50 - K : 51 + K]) in found and len(found) == 2
    weak = {canon(r.seq) for r in G.bubbles(graph, 3, 13).collect()}
    assert weak == {canon(BUBBLE[50 - K : 51 + K])}
    left = G.simplify(graph.edges, 3, 13)
    assert [r.seq for r in G.vertices(left).collect()] == [min(TEXT, rc(TEXT), key=lambda x: x.translate(str.maketrans("CATG", "0123")))]


def test_variant_text_stands_for_both_branches(graph):
    (row,) = G.variants(graph).select("text", "n_alts", G.expand(F.col("text")).alias("all"), G.text_quality(F.col("text")).alias("q")).collect()
    assert row.n_alts == 2 and {canon(x) for x in row.all} == {canon(TEXT[250 - K : 251 + K]), canon(BUBBLE[50 - K : 51 + K])}
    assert row.q == "3" * K + "2" + "3" * K


def test_links_join_ends_to_starts(graph):
    seqs = {r.id: r.seq for r in G.vertices(graph).collect()}
    for r in G.links(graph).collect():
        near = seqs[r.dst] if r.strand == "+" else rc(seqs[r.dst])
        assert seqs[r.src][-K:] == near[:K] if r.side == "r" else near[-K:] == seqs[r.src][:K]
    assert {len(r.record.split("\n")) for r in G.vertex_text(graph).collect()} == {4}
    assert {r.line.split("\t")[0] for r in G.edge_text(graph).collect()} == set(seqs)


def test_reads_run_through_the_graph_or_do_not(spark, graph):
    reads = spark.createDataFrame([(1, TEXT[10:110]), (2, rc(TEXT[180:320])), (3, TEXT[10:60] + dna(50)), (4, TEXT[5:20])], "read_id long, seq string")
    got = {(r.read_id, r.strand): r for r in G.read_paths(graph, reads).collect()}
    assert {k[0] for k in got} == {1, 2} and len(got) == 4
    seqs = {r.id: r.seq for r in G.vertices(graph).collect()}
    for (i, strand), r in got.items():
        read = TEXT[10:110] if i == 1 else rc(TEXT[180:320])
        read = read if strand == "+" else rc(read)
        spelled = ""
        for v in r.path:
            s = next(s for s in (seqs[v], rc(seqs[v])) if (not spelled and read[: K + 1] in s) or (spelled and s[:K] == spelled[-K:]))
            spelled = s if not spelled else spelled + s[K:]
        assert spelled[r.start :].startswith(read)


def test_cycle_counts_reads_through_it(spark):
    g = G.build(spark.createDataFrame([(x, 3) for x in sorted(set(kp1s(AROUND)))], "kp1 string, freq int"))
    reads = spark.createDataFrame([(1, AROUND), (2, rc(AROUND)), (3, AROUND[:190]), (4, LOOP)], "read_id long, seq string")
    (row,) = G.self_cycles(g, reads, 2).collect()
    assert canon(row.seq) == canon(LOOP) and row.support == 2


def test_order_of_a_chain(spark):
    gaps = spark.createDataFrame([(1, 2, 10.0, 1.0, 0.1), (2, 3, 20.0, 1.0, 0.2), (7, 8, -5.0, 2.0, 0.0)], "u1 long, u2 long, gap double, sd double, score double")
    ordered = S.order(gaps)
    got = sorted((r.group_id, r.ord, r.unitig, r.gap) for r in ordered.collect())
    assert got == [(1, 1, 1, 0.0), (1, 2, 2, 10.0), (1, 3, 3, 20.0), (7, 1, 7, 0.0), (7, 2, 8, -5.0)]
    seqs = spark.createDataFrame([(1, "AA"), (2, "CC"), (3, "GG"), (7, "T"), (8, "A")], "unitig long, seq string")
    assert {r.seq for r in S.sequences(ordered, seqs).collect()} == {"AA" + "N" * 10 + "CC" + "N" * 20 + "GG", "TA"}
