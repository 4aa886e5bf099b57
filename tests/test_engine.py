import gzip
import random

import pytest
from pyspark.sql import functions as F
from test_iterative import rc

from strandloom import engine as E
from strandloom.__main__ import arguments
from strandloom.operators import libraries as L

RNG = random.Random(3)
CONFIG = """[global_setting]
max_rd_len = 100
[LIB]
name = pairs ; inserts of 300
avg_insert_len = 300
insert_SD = 30
diverse_rd_len = 1
asm_flag = 1
seq_profile = 1
qual_benchmark = 33
f1 = {0}/a_1.fq.gz
f2 = {0}/a_2.fq.gz
[LIB]
name = singles
diverse_rd_len = 0
asm_flag = 1
seq_profile = 2
qual_benchmark = 33
sf1 = {0}/s.fa
"""


def dna(n):
    return "".join(RNG.choice("ACGT") for _ in range(n))


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("engine")
    left, gap, right = dna(500), dna(60), dna(500)
    whole = left + gap + right
    with gzip.open(folder / "a_1.fq.gz", "wt") as one, gzip.open(folder / "a_2.fq.gz", "wt") as two:
        n = 0
        for at in range(0, len(whole) - 300, 5):
            a, b = whole[at : at + 100], rc(whole[at + 200 : at + 300])
            # no read covers the gap, so that two unitigs are left
            if any(s < 560 and s + 100 > 500 for s in (at, at + 200)):
                continue
            for f, s in ((one, a), (two, b)):
                f.write(f"@r{n} x\n{s}\n+\n{'I' * 100}\n")
            n += 1
    with open(folder / "s.fa", "w") as f:
        for at in range(0, 390, 10):
            f.write(f">s{at}\n{left[at : at + 50]}\n{left[at + 50 : at + 110]}N\n")
    with open(folder / "q.fa", "w") as f:
        f.write(f">q1\n{left[100:220]}\n>q2\n{dna(90)}\n>q3\n{left[100:150]}N{left[151:200]}\n")
    out = str(folder / "out")
    engine = E.Engine(spark, out, E.Settings(k=33)).index(CONFIG.format(folder)).graph(E.Curve(3, 13)).map_reads()
    engine.overlaps(str(folder / "q.fa")).scaffold()
    return E.Engine(spark, out), left, right


def test_index_counts_what_passes(run):
    engine, left, right = run
    reads = engine.table("reads").collect()
    assert {len(r.seq) for r in reads if r.mate == 0} == {110} and {r.seq_profile for r in reads if r.mate == 0} == {2}
    assert all(r.insert_size == (300 if r.mate else 0) for r in reads)
    hist = {r.freq: r.n for r in engine.table("histogram").collect()}
    assert len(hist) == 255 and sum(n for f, n in hist.items() if f >= 2) == engine.table("kmers").count()


def test_graph_and_places(run):
    engine, left, right = run
    seqs = {r.id: r.seq for r in engine.table("vertices").collect()}
    assert len(seqs) == 2 and all(any(s in x or rc(s) in x for x in (left, right)) for s in seqs.values())
    for r in engine.table("places").join(engine.table("reads"), "read_id").collect():
        read = r.seq if r.strand == "+" else rc(r.seq)
        assert seqs[r.id][r.start :].startswith(read) and r.cigar == f"{len(read)}M" and r.n_gaps == 0


def test_scaffold_spans_the_gap(run):
    engine, left, right = run
    (row,) = engine.table("scaffolds").collect()
    seq = row.seq if row.seq[:60] in left else rc(row.seq)
    a, b = [x for x in seq.split("N") if x]
    assert row.n_unitigs == 2 and a in left and b in right
    missing = len(left) - left.index(a) - len(a) + 60 + right.index(b)
    assert abs(seq.count("N") - missing) <= 1


def test_overlaps_of_a_file(run):
    engine, left, _ = run
    seqs = {r.read_id: r.seq for r in engine.table("reads").collect()}
    got = {(r.rid, r.strand): r.consis_len for r in engine.table("overlaps").collect() if r.qid == "q1"}
    assert {r.qid for r in engine.table("overlaps").select("qid").distinct().collect()} == {"q1"} and got
    for (rid, strand), n in got.items():
        q = left[100:220] if strand == "+" else rc(left[100:220])
        assert seqs[rid][:n] in q


def test_manifest_passes_settings_on(run):
    engine, *_ = run
    assert engine.settings == E.Settings(k=33) and engine.curve() == E.Curve(3, 13)
    assert [r.stage for r in engine.table("stages").orderBy("stage").collect()] == ["graph", "index", "map_reads", "overlaps", "scaffold"]


def test_curve():
    one = [90, 40, 10, 5, 8, 20, 40, 60, 80, 60, 40, 10] + [0] * 243
    assert E.curve(one) == E.Curve(4, 9)
    two = [90, 10, 5, 8, 20, 40, 60, 40, 30, 32, 34, 36, 50, 70, 60, 40] + [0] * 239
    assert E.curve(two) == E.Curve(3, 14, True)
    with pytest.raises(ValueError):
        E.curve([1] * 255)


def test_settings_and_arguments():
    assert E.Settings(k=34).k == 35 and E.Settings().k == 63
    for bad in ({"k": 31}, {"k": 257}, {"quality": 5}, {"heterozygosity": 0}):
        with pytest.raises(ValueError):
            E.Settings(**bad)
    a = arguments(["index", "-c", "x.ini", "-K", "35", "-q", "1"])
    assert (a.stage, a.config, a.k, a.quality) == ("index", "x.ini", 35, 1)


def test_filters(spark):
    rows = [
        (0, 0, 0, 1, "A" * 50, "I" * 50), (0, 0, 0, 2, "C" * 50, "I" * 50),  # good
        (0, 0, 1, 1, "A" * 50, "I" * 50), (0, 0, 1, 2, "C" * 42, "I" * 42),  # mate too short
        (0, 0, 2, 1, "G" * 50, "I" * 49 + "#"), (0, 0, 2, 2, "C" * 50, "I" * 50),  # a poor base
        (0, 0, 3, 1, "T" * 50, None), (0, 0, 3, 2, "C" * 50, "#" * 50),  # qualities missing
        (1, 0, 0, 0, "ACGTN" + "g" * 45 + "N" + "T" * 45, "I" * 96), (1, 0, 1, 0, "A" * 60, "I" * 60), (1, 0, 2, 0, "A" * 44, "I" * 44),
    ]
    df = spark.createDataFrame(rows, "lib_id int, pair_file int, num long, mate int, seq string, qual string")
    libs = [{"paired": True, "diverse_rd_len": 1, "qual_benchmark": 33}, {"paired": False, "diverse_rd_len": 0, "qual_benchmark": 33}]
    got = lambda q: {(r.lib_id, r.num, r.mate, r.seq) for r in L.prepared(df, libs, 33, q).collect()}
    strict = {(0, 0, 1, "A" * 50), (0, 0, 2, "C" * 50), (0, 3, 1, "T" * 50), (0, 3, 2, "C" * 50), (1, 0, 0, "G" * 45), (1, 1, 0, "A" * 45)}
    assert got(3) == strict and got(2) == got(4) == strict | {(0, 2, 1, "G" * 50), (0, 2, 2, "C" * 50)}
    assert spark.range(1).select(L.region(F.lit("AANCCNGG"))["start"]).first()[0] == 0
