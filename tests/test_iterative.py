import gzip
import random
from collections import defaultdict

import pytest

from strandloom.plans import iterative as M
from strandloom.plans.views import K
from strandloom.sources import reads as R

ORDER = str.maketrans("CATG", "0123")


def rc(s):
    return s.translate(str.maketrans("ACGT", "TGCA"))[::-1]


def canon(s):
    return min(s, rc(s), key=lambda x: x.translate(ORDER))


def brute(kp1s):
    edges = set(kp1s) | {rc(x) for x in kp1s}
    out, into = defaultdict(list), defaultdict(list)
    for e in edges:
        out[e[:K]].append(e)
        into[e[1:]].append(e)
    found = set()
    for e in edges:
        if len(into[e[:K]]) == 1 and len(out[e[:K]]) == 1:
            continue
        s = e
        while len(into[s[-K:]]) == 1 and len(out[s[-K:]]) == 1:
            s += out[s[-K:]][0][-1]
        found.add(canon(s))
    return found


def test_unitigs_equal_a_walk(spark):
    rng = random.Random(1)
    dna = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    shared = dna(60)
    texts = [dna(90) + shared + dna(70), dna(50) + shared + dna(40), dna(200)]
    cycle = dna(80)
    texts.append(cycle + cycle[: K + 1])
    kp1s = sorted({canon(t[i : i + K + 1]) for t in texts for i in range(len(t) - K)})
    got = M.unitigs(spark.createDataFrame([(x, 3) for x in kp1s], "kp1 string, freq int")).collect()
    assert {r.seq for r in got} == brute(kp1s) and all(r.mean_freq == 3 and r.n_kmers == len(r.seq) - K + 1 for r in got)


def test_groups(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (7, 8), (9, 8), (3, 20)], "u1 long, u2 long")
    assert dict(map(tuple, M.groups(links).collect())) == {1: 1, 2: 1, 3: 1, 20: 1, 7: 7, 8: 7, 9: 7}


def test_fastx(spark, tmp_path):
    (tmp_path / "a.fa").write_text("junk\n>r1 some comment\nACG\nTNN\n>r2\n\n")
    with gzip.open(tmp_path / "b.fq.gz", "wt") as f:
        f.write("@q1 x\nACGT\nAC\n+q1\n@III\n@I\n@q2\nA\n+\n+\n")
    got = {(r.name, r.comment, r.seq, r.qual) for r in R.read_fastx(spark, str(tmp_path / "a.fa"), str(tmp_path / "b.fq.gz")).collect()}
    assert got == {("r1", "some comment", "ACGTNN", None), ("r2", "", "", None), ("q1", "x", "ACGTAC", "@III@I"), ("q2", "", "A", "+")}
    with pytest.raises(ValueError, match="qualities"):
        list(R.records(iter(["@r\n", "ACGT\n", "+\n", "II\n"])))


def test_libraries():
    text = "[global_setting]\nmax_rd_len=150 ; longest\n[LIB]\nname=a\navg_insert_len=300\ninsert_SD=30\ndiverse_rd_len=0\nasm_flag=3\nseq_profile=1\nqual_benchmark=33\nf1=x_1.fq\nf2=x_2.fq\n[LIB]\nname=b\ndiverse_rd_len=1\nasm_flag=1\nseq_profile=2\nqual_benchmark=64\nsf1=y.fq\n"
    settings, libs = R.parse_libraries(text)
    assert settings == {"max_rd_len": 150} and [x["paired"] for x in libs] == [True, False]
    assert libs[0]["files"] == ["x_1.fq", "x_2.fq"] and libs[1]["files"] == ["y.fq"] and libs[0]["insert_sd"] == 30
    for bad in (text.replace("asm_flag=3", "asm_flag=9"), text.replace("name=b", "name=a"), text.replace("max_rd_len=150", "x=1"), text.replace("sf1=y.fq", "")):
        with pytest.raises((ValueError, KeyError)):
            R.parse_libraries(bad)


def test_files_are_streamed(spark, tmp_path):
    """Two gzip members make one file; a worker holds a fraction of what it unpacks to."""
    import gzip

    from strandloom.sources import reads as R

    body = "".join(f"@r{k} x\n{'ACGT' * 25}\n+\n{'I' * 100}\n" for k in range(60_000)).encode()
    path = tmp_path / "big file.fq.gz"
    path.write_bytes(gzip.compress(body) + gzip.compress(body))
    got = R.read_fastx(spark, str(path), numbered=True)
    assert got.count() == 120_000 and got.selectExpr("max(num)").first()[0] == 119_999 and got.where("name = 'r59999' AND num = 119999 AND seq = repeat('ACGT', 25)").count() == 1

    batches = R._parse([{"path": type("P", (), {"to_pylist": lambda self: [str(path)]})()}])
    assert max(b.nbytes for b in batches) < 4 * R.BUFFER
