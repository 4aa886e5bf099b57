import random

import pytest
from test_graph import K, TEXT, dna, swap
from test_iterative import rc

from strandloom.operators import alignment as A

RNG = random.Random(11)


def test_align_takes_the_place_with_fewest_differences(spark):
    targets = spark.createDataFrame([("a", TEXT[:200]), ("b", TEXT[150:])], "id string, seq string")
    reads = spark.createDataFrame([(1, TEXT[20:120]), (2, rc(swap(TEXT[220:320], 40))), (3, swap(swap(swap(TEXT[20:120], 5), 6), 7))], "read_id long, seq string")
    got = {r.read_id: tuple(r)[1:] for r in A.align(reads, targets).collect()}
    assert got == {1: ("a", "+", 20, 0, "100M"), 2: ("b", "-", 70, 1, "40M1U59M")}


def brute_fit(seq, window, gaps, limit):
    """Every way to lay a sequence into a window with single-base gaps, by recursion."""
    best = None

    def walk(i, j, mism, used, marks, shift):
        nonlocal best
        if mism > limit or used > gaps or abs(j - i - gaps) > gaps:
            return
        if i == len(seq):
            key = (mism + used, used, abs(j - i - gaps))
            if best is None or key < best[0]:
                best = (key, mism, used)
            return
        if j < len(window) and window[j] != "-":
            walk(i + 1, j + 1, mism + (seq[i] != window[j]), used, None, shift)
        if i and j + 1 < len(window) and window[j + 1] != "-":
            walk(i + 1, j + 2, mism + (seq[i] != window[j + 1]), used + 1, None, shift)
        if i and i + 1 < len(seq) and j < len(window) and window[j] != "-":
            walk(i + 2, j + 1, mism + (seq[i + 1] != window[j]), used + 1, None, shift)

    for t in range(2 * gaps + 1):
        walk(0, t, 0, 0, None, t)
    return best and best[1:]


def test_fit_equals_brute_force_and_its_marks_add_up():
    for gaps in (0, 1, 2):
        seqs, windows = [], []
        for _ in range(150):
            w = dna(24 + 2 * gaps)
            s = list(w[gaps + RNG.randint(-gaps, gaps) :][:24])
            for _ in range(RNG.randint(0, gaps)):
                at = RNG.randrange(1, len(s) - 1)
                s[at : at + RNG.randint(0, 1)] = [] if RNG.random() < 0.5 else [s[at], s[at]]
            s = "".join(s)[:24].ljust(24, "A")
            s = swap(s, RNG.randrange(24)) if RNG.random() < 0.5 else s
            seqs.append(s)
            windows.append("-" * RNG.randint(0, gaps) + w[: 24 + 2 * gaps])
            windows[-1] = windows[-1][: 24 + 2 * gaps]
        for s, w, got in zip(seqs, windows, A.fit(seqs, windows, gaps, 3), strict=True):
            want = brute_fit(s, w, gaps, 3)
            assert (got and got[:2]) == want
            if got:
                mism, used, shift, marks = got
                assert marks.count("U") == mism and marks.count("I") + marks.count("D") == used
                i, j = 0, gaps + shift
                first = j
                for m in marks:
                    assert m in "ID" or (s[i] == w[j]) == (m == "M")
                    i, j = i + (m != "D"), j + (m != "I")
                assert i == len(s) and first >= 0


def test_gapped_align_finds_lost_and_repeated_bases(spark):
    targets = spark.createDataFrame([("a", TEXT[:200]), ("b", TEXT[150:])], "id string, seq string")
    whole = TEXT[20:140]
    lost, extra = whole[:70] + whole[71:], whole[:70] + whole[69:]
    two = TEXT[20:70] + TEXT[71:90] + TEXT[91:130]
    reads = spark.createDataFrame([(1, lost), (2, rc(extra)), (3, whole), (4, two), (5, TEXT[0:110][1:50] + TEXT[51:110])], "read_id long, seq string")
    got = {r.read_id: r for r in A.align_gapped(reads, targets).collect()}
    assert set(got) == {1, 2, 3, 5}
    assert all((got[i].id, got[i].start, got[i].mismatches, got[i].n_gaps) == ("a", 20, 0, n) for i, n in ((1, 1), (2, 1), (3, 0)))
    assert got[2].strand == "-" and got[3].cigar == "120M" and "1D" in got[1].cigar and "1I" in got[2].cigar and got[5].start == 1


@pytest.mark.parametrize(
    ("a", "b", "before", "allowed", "want"),
    [
        ("ACGTACGT", "ACGTACGT", "C", 0, 0), ("ACGTACGT", "ACGAACGT", "C", 0, None), ("ACGTACGT", "ACGAACGT", "C", 1, 1), ("", "ACG", "A", 0, 0),
        ("AACGTTGCA", "ACGTTGCA", "C", 1, 1), ("ACGTTGCA", "AACGTTGCA", "C", 1, 1), ("GACGTTGCA", "ACGTTGCA", "G", 1, 1), ("GACGTTGCA", "ACGTTGCA", "T", 1, None),
        ("ACGTCCGTAAAC", "ACGAGCGTAAAC", "T", 2, 2), ("ACGTCCGTAAAC", "ACGAGCGTAAAC", "T", 1, None), ("ACGT", "ACGA", "T", 1, 1),
    ],
)
def test_differences(a, b, before, allowed, want):
    assert A.differences(a, b, before, allowed) == want


def test_flanks_share_what_is_allowed(spark):
    reads = spark.createDataFrame([(1, TEXT[0:100]), (2, TEXT[40:140]), (3, swap(TEXT[50:150], K + 9)), (4, rc(TEXT[0:100]))], "read_id long, seq string")
    pairs = A.flank_pairs(reads)
    strict = {(r.qid, r.rid, r.strand): (r.n_diff, r.consis_len) for r in A.flanks(pairs, 0).collect()}
    loose = {(r.qid, r.rid, r.strand): (r.n_diff, r.consis_len) for r in A.flanks(pairs, 1).collect()}
    assert strict == {(1, 2, "+"): (0, 60), (4, 2, "-"): (0, 60), (1, 4, "-"): (0, 100), (4, 1, "-"): (0, 100), (2, 4, "-"): (0, 60)}
    assert loose == strict | {(1, 3, "+"): (1, 49), (2, 3, "+"): (1, 89), (4, 3, "-"): (1, 49)}


def test_reads_reach_over_both_ends(spark):
    targets = spark.createDataFrame([("x", TEXT[100:200])], "id string, seq string")
    reads = spark.createDataFrame([(1, TEXT[150:210]), (2, rc(TEXT[160:206])), (3, TEXT[92:140]), (4, TEXT[90:150]), (5, swap(TEXT[150:210], 55))], "read_id long, seq string")
    pool = A.flank_pool(reads, targets)
    assert {(r.side, r.read_id, r.ext) for r in pool.collect()} == {("r", 1, TEXT[200:210]), ("r", 2, TEXT[200:206]), ("r", 5, swap(TEXT[150:210], 55)[50:]), ("l", 3, rc(TEXT[92:100])), ("l", 4, rc(TEXT[90:100]))}
    assert {(r.side, r.ext, r.support) for r in A.extensions(pool).collect()} == {("r", TEXT[200:205], 3), ("l", rc(TEXT[92:100]), 2)}
    # reads that end earlier have no say on what follows
    (row,) = A.extensions(spark.createDataFrame([("x", "r", e) for e in ("ACGT", "ACGT", "AC", "AC", "A")], "id string, side string, ext string")).collect()
    assert tuple(row) == ("x", "r", "ACGT", 2)


def test_groups_of_mapped_reads(spark):
    mapped = spark.createDataFrame([(1, "c", "+", 5, "40M"), (2, "b", "-", 7, "40M"), (3, "d", "+", 0, "9M"), (5, "b", "+", 1, "9M"), (6, "a", "+", 1, "9M")], "read_id long, id string, strand string, start int, cigar string")
    mates = spark.createDataFrame([(i, i - 1 + i % 2, 2 - i % 2) for i in range(1, 7)], "read_id long, pair_id long, mate int")
    got = sorted(tuple(r) for r in A.mapped_groups(mapped, mates).collect())
    assert [r[:2] for r in got] == [("a", "a"), ("a", "b"), ("a", "b"), ("a", "c"), ("d", "d")]
    assert got[0][2] == "5\t2\ta\t1\t9M\t+"
