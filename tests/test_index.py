import random
from collections import Counter

from pyspark.sql import functions as F

from strandloom.operators import index as M


def test_numbers_follow_a_global_order(spark):
    rows = [(k * 7919 % 1000, f"v{k}") for k in range(1000)]
    got = M.numbered(spark.createDataFrame(rows, "a int, v string").repartition(9), "k", "a", "v").collect()
    assert [(r.a, r.v) for r in sorted(got, key=lambda r: r.k)] == sorted(rows) and sorted(r.k for r in got) == list(range(1, 1001))
    assert M.numbered(spark.range(0), "k", "id").collect() == []


def test_positions_in_reads_of_any_length(spark):
    rng = random.Random(1)
    reads = [(k, "A" * rng.choice([0, 1, 5, 100, 3000])) for k in range(80)]
    laid, want, at = M.offsets(spark.createDataFrame(reads, "read_id long, seq string").repartition(5), "read_id", F.length("seq")), {}, 0
    for k, s in reads:
        want |= {at + i: (k, i) for i in range(len(s))}
        at += len(s)
    some = sorted(rng.sample(range(at), 300))
    got = M.locate(spark.createDataFrame([(p,) for p in some], "pos long"), laid, "read_id").collect()
    assert {r.pos: (r.read_id, r.off) for r in got} == {p: want[p] for p in some} and len(got) == len(some)


def test_window_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = ["", None, "abc", "q" * 33, "Q" * 34, "né9 " * 30, *("".join(rng.choice("abcdefgh Z.1") for _ in range(rng.randint(30, 400))) for _ in range(20))]
    texts += [texts[-1], texts[-2][::-1]]
    base = {c: b for c, b in zip(M.UPPER, M.BASES, strict=True)}
    want = Counter()
    for t in texts:
        digits = ["ACGT".index(base[c]) for c in (t or "").upper() if c in base]
        for i in range(len(digits) - M.K):
            w = digits[i : i + M.K + 1]
            w = min(w, [3 - x for x in reversed(w)])
            want[tuple(sum(x * 4 ** (16 - j) for j, x in enumerate(h)) for h in (w[:17], w[17:]))] += 1
    before = M.PIECE
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {(r.hi, r.lo): r.n for r in M.text_window_counts(frame).collect()} == want
    from strandloom.operators.index import _canonical
    import pyarrow as pa

    try:
        M.PIECE = 40
        got = Counter(zip(*(c.to_pylist() for c in next(_canonical([pa.RecordBatch.from_pydict({"text": texts})])).columns), strict=True))
    finally:
        M.PIECE = before
    assert got == want


def test_window_counts_of_parts_and_repeats(spark):
    """Runs dealt out over many parts and taken apart in shares, equal runs as one, texts that end within a piece."""
    import pyarrow as pa
    import pyarrow.compute

    rng = random.Random(3)
    texts = ["a" * 3000, "ab" * 700, *("".join(rng.choice("abcdefghijklmnop .") for _ in range(rng.choice([33, 34, 40, 300, 900]))) for _ in range(30))]
    texts += [texts[5]] * 100 + [texts[9][::-1], None, ""]
    want = Counter(zip(*(c.to_pylist() for c in next(M._canonical([pa.RecordBatch.from_pydict({"text": texts})])).columns), strict=True))
    kept = {name: getattr(M, name) for name in ("PIECE", "SLICE", "HELD")}
    try:
        for parts, piece, slice_, held in ((1, 1 << 20, 1 << 16, 1 << 20), (7, 1000, 40, 50), (3, 300, 20, 5)):
            M.PIECE, M.SLICE, M.HELD = piece, slice_, held
            dealt = pa.Table.from_batches(M._dealt([pa.RecordBatch.from_pydict({"text": texts})], parts))
            got, seen = Counter(), 0
            for part in set(dealt["part"].to_pylist()):
                mine = dealt.filter(pa.compute.equal(dealt["part"], part)).to_batches()
                for hi, lo, n in M._counted(mine):
                    seen += len(hi)
                    got.update(dict(zip(zip(hi.tolist(), lo.tolist(), strict=True), n.tolist(), strict=True)))
            assert got == want and seen == len(want)
    finally:
        for name, value in kept.items():
            setattr(M, name, value)
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)
    assert {r.freq: r.n for r in M.text_window_hist(frame, 255).collect()} == Counter(min(n, 255) for n in want.values())


def test_windows_are_dealt_out_in_few_bytes():
    """A task sends about two bytes a window, in pieces, whatever the size of a batch (16 bytes a window, all at once, filled workers and disks)."""
    import pyarrow as pa

    rng = random.Random(4)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)) for _ in range(8)]
    sizes = [sum(len(x.as_py()) for x in b["runs"]) for b in M._dealt([pa.RecordBatch.from_pydict({"text": texts})], 5)]
    assert sum(sizes) < 2 * 8 * 300_000 and max(sizes) <= 2 * M.PIECE
