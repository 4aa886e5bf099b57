"""Reads against unitigs: without gaps, with single-base gaps, at the flanks of a seed, and over the ends of unitigs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.dna import letters, revcomp
from strandloom.plans.iterative import groups
from strandloom.plans.views import K

#: Bases between two seeds of a read; shares of a read's bases that may differ, and at which a base may be missing or too many.
STEP, MISMATCHES, GAPS = 5, 0.02, 0.01
#: Cells of a table of choices that are held at once.
CELLS = 8_000_000


def strands(reads: DataFrame) -> DataFrame:
    return reads.select("read_id", F.lit("+").alias("strand"), "seq").union(reads.select("read_id", F.lit("-"), revcomp(F.col("seq"))))


def places(reads: DataFrame, targets: DataFrame, step: int = STEP, k: int = K) -> DataFrame:
    """(read_id, strand, seq, id, start) where a seed of k bases at every step-th base of a read, on either strand, meets a target."""
    seeds = strands(reads).where(F.length("seq") >= k).select("read_id", "strand", "seq", F.explode(F.sequence(F.lit(0), F.length("seq") - k, F.lit(step))).alias("o")).withColumn("seed", F.expr(f"substr(seq, o + 1, {k})"))
    spots = targets.where(F.length("seq") >= k).select("id", F.explode(F.sequence(F.lit(0), F.length("seq") - k)).alias("p"), F.col("seq").alias("whole")).select("id", "p", F.expr(f"substr(whole, p + 1, {k})").alias("seed"))
    return seeds.join(spots.hint("merge"), "seed").select("read_id", "strand", "seq", "id", (F.col("p") - F.col("o")).alias("start")).distinct()


def seed_hits(reads: DataFrame, targets: DataFrame, least: int = STEP, k: int = K) -> DataFrame:
    """(id, p, rid): places, from 1, of targets (id, seq) where a read (rid, seq) starts with the same k bases.

    Targets shorter than k + least are passed over.
    """
    spots = targets.where(F.length("seq") >= k + least).select("id", F.explode(F.sequence(F.lit(1), F.length("seq") - (k - 1))).alias("p"), "seq").select("id", "p", F.expr(f"substr(seq, p, {k})").alias("seed"))
    return spots.join(reads.where(F.length("seq") >= k).select("rid", F.substring("seq", 1, k).alias("seed")), "seed").select("id", "p", "rid")


def cigar(marks: Column) -> Column:
    """Runs of letters as counts and letters."""
    return F.array_join(F.transform(F.regexp_extract_all(marks, F.lit("(M+|U+|I+|D+)"), F.lit(1)), lambda x: F.concat(F.length(x).cast("string"), F.substring(x, 1, 1))), "")


def align(reads: DataFrame, targets: DataFrame, step: int = STEP, rate: float = MISMATCHES, k: int = K) -> DataFrame:
    """(read_id, id, strand, start, mismatches, cigar): each read's best place without gaps in targets (id, seq).

    At most `rate` of the bases may differ; ties go to the smaller id, place and strand. CIGAR letters: M equal, U different.
    """
    laid = places(reads, targets, step, k).where("start >= 0").join(targets.select("id", F.col("seq").alias("whole")), "id").where("start + length(seq) <= length(whole)")
    # one cut per place: a look for each base would walk a long target each time
    part = F.expr("substr(whole, start + 1, length(seq))")
    marks = F.array_join(F.zip_with(letters(F.col("seq")), letters(part), lambda x, y: F.when(x == y, "M").otherwise("U")), "")
    scored = laid.withColumn("marks", marks).withColumn("mismatches", F.length(F.replace("marks", F.lit("M"), F.lit("")))).where(F.col("mismatches") <= rate * F.length("seq"))
    best = scored.groupBy("read_id").agg(F.min(F.struct("mismatches", "id", "start", "strand", "marks")).alias("b")).select("read_id", "b.*")
    return best.select("read_id", "id", "strand", "start", "mismatches", cigar(F.col("marks")).alias("cigar"))


def fit(seqs: list[str], windows: list[str], gaps: int, limit: int) -> list[tuple[int, int, int, str] | None]:
    """(mismatches, gaps, shift, marks) of each sequence's best fit into its window, or None where it takes more than `limit` mismatches.

    Sequences are n long and windows n + 2 * gaps; '-' in a window stands for no base. A gap is one base, and between two
    gaps at least one base is aligned. Fewest mismatches and gaps together win, then fewest gaps, then the least shift from
    the middle, then the smaller one. Marks: M equal, U different, I a base of the sequence alone, D one of the window alone.
    """
    q, r = (np.frombuffer("".join(x).encode(), np.uint8).reshape(len(x), -1) for x in (seqs, windows))
    rows, n = q.shape
    wide, lost = 2 * gaps + 1, 1 << 13
    cost = np.full((3, gaps + 1, wide, rows), lost, np.int16)
    cost[0, 0] = 0
    how = np.zeros((n, gaps + 1, wide, rows), np.uint8)
    for i in range(n):
        last, old, new = cost[i % 3], cost[(i - 1) % 3], cost[(i + 1) % 3]
        for t in range(wide):
            ref = r[:, i + t]
            here = (q[:, i] != ref).astype(np.int16)
            here[ref == ord("-")] = lost
            for g in range(gaps + 1):
                best, way = last[g, t].copy(), how[i, g, t]
                if g and t and i:
                    less = last[g - 1, t - 1] < best
                    best[less], way[less] = last[g - 1, t - 1][less], 1
                if g and t + 1 < wide and i > 1:
                    less = old[g - 1, t + 1] < best
                    best[less], way[less] = old[g - 1, t + 1][less], 2
                new[g, t] = np.minimum(best + here, lost)
    end = cost[n % 3].astype(np.int64)
    g, t = np.indices(end.shape[:2])
    rank = np.where(end <= limit, (end + g[..., None]) * 10**6 + (g * 10**4 + abs(t - gaps) * 10 + (t > gaps))[..., None], 1 << 60).reshape(-1, rows)
    pick = rank.argmin(axis=0)
    each = np.arange(rows)
    found = rank[pick, each] < 1 << 60
    g, t = pick // wide, pick % wide
    mism, used = end[g, t, each], g.copy()
    marks = np.zeros((rows, n + gaps), np.uint8)
    pos, i = np.full(rows, n + gaps), np.full(rows, n - 1)
    while (live := each[found & (i >= 0)]).size:
        at = i[live]
        way = how[at, g[live], t[live], live]
        pos[live] -= 1
        marks[live, pos[live]] = np.where(q[live, at] == r[live, at + t[live]], ord("M"), ord("U"))
        gap = live[way > 0]
        pos[gap] -= 1
        marks[gap, pos[gap]] = np.where(way[way > 0] == 1, ord("D"), ord("I"))
        g[gap] -= 1
        t[live] += np.choose(way, [0, -1, 1])
        i[live] -= np.choose(way, [1, 1, 2])
    return [(int(mism[x]), int(used[x]), int(t[x]) - gaps, marks[x, pos[x] :].tobytes().decode()) if found[x] else None for x in range(rows)]


def _fitted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for (n, gaps, limit), same in batch.groupby([batch["seq"].str.len(), "gaps", "limit"]):
            size = max(1, CELLS // (n * (gaps + 1) * (2 * gaps + 1)))
            for lo in range(0, len(same), size):
                part = same.iloc[lo : lo + size]
                got = fit(part["seq"].tolist(), part["window"].tolist(), int(gaps), int(limit))
                rows = [(i, v, s, p + x[2], x[0], x[1], x[3]) for i, v, s, p, x in zip(part["read_id"], part["id"], part["strand"], part["start"], got, strict=True) if x]
                yield pd.DataFrame(rows, columns=["read_id", "id", "strand", "start", "mismatches", "n_gaps", "marks"])


def align_gapped(reads: DataFrame, targets: DataFrame, step: int = STEP, rate: float = MISMATCHES, gap_rate: float = GAPS, k: int = K) -> DataFrame:
    """(read_id, id, strand, start, mismatches, n_gaps, cigar): each read's best place in targets (id, seq), single-base gaps allowed.

    For reads of machines that drop or repeat bases. At most `rate` of a read's bases may differ and `gap_rate` of their
    number be gaps; a read shorter than 1 / gap_rate has none. Fewest mismatches and gaps win, then fewest gaps, then the
    smaller id, place and strand. I marks a base of the read alone, D one of the target alone.
    """
    spread = places(reads, targets, step, k).withColumn("gaps", F.floor(F.length("seq") * gap_rate).cast("int")).withColumn("limit", F.floor(F.length("seq") * rate).cast("int"))
    laid = spread.join(targets.select("id", F.col("seq").alias("whole")), "id").where("start >= -gaps and start + length(seq) <= length(whole) + gaps")
    window = "rpad(concat(repeat('-', greatest(gaps - start, 0)), substr(whole, greatest(start - gaps, 0) + 1, length(seq) + 2 * gaps - greatest(gaps - start, 0))), length(seq) + 2 * gaps, '-')"
    ready = laid.select("read_id", "id", "strand", F.col("start").cast("long").alias("start"), "seq", F.expr(window).alias("window"), "gaps", "limit")
    kind = {f.name: f.dataType.simpleString() for f in ready.schema}
    found = ready.mapInPandas(_fitted, f"read_id {kind['read_id']}, id {kind['id']}, strand string, start long, mismatches int, n_gaps int, marks string")
    key = F.struct((F.col("mismatches") + F.col("n_gaps")).alias("all"), "n_gaps", "id", "start", "strand", "mismatches", "marks")
    best = found.groupBy("read_id").agg(F.min(key).alias("b")).select("read_id", "b.*")
    return best.select("read_id", "id", "strand", "start", "mismatches", "n_gaps", cigar(F.col("marks")).alias("cigar"))


def differences(a: str, b: str, before: str, allowed: int, step: int = STEP) -> int | None:
    """How many bases differ between two flanks of a seed up to the end of the shorter one; None beyond `allowed`.

    Where they differ, a run of other bases, or of bases too many in one flank that repeat the base before, is passed over
    if `step` equal bases (or all that are left) follow; other bases come before repeats, short runs before long ones.
    """
    i = j = used = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
            continue
        prev = a[i - 1] if i else before
        runs = range(1, allowed - used + 1)
        ways = [(z, z) for z in runs] + [w for z in runs for w, extra in (((z, 0), a[i : i + z]), ((0, z), b[j : j + z])) if extra == prev * z]
        for di, dj in ways:
            x, y = a[i + di : i + di + step], b[j + dj : j + dj + step]
            n = min(len(x), len(y))
            if x[:n] == y[:n]:
                i, j, used = i + di, j + dj, used + max(di, dj)
                break
        else:
            return None
    return used


def flanks(pairs: DataFrame, allowed: int, step: int = STEP) -> DataFrame:
    """Pairs (left_a, left_b, right_a, right_b, seed) whose flanks agree, with n_diff and consis_len.

    Left flanks are read outwards from the seed. Both sides share the allowed differences; consis_len is the length of the
    seed and of the shorter flank on each side, less the differences. With none allowed only equal flanks agree.
    """

    @F.pandas_udf("int")
    def count(la: pd.Series, lb: pd.Series, ra: pd.Series, rb: pd.Series, seed: pd.Series) -> pd.Series:
        out = []
        for a, b, c, d, s in zip(la, lb, ra, rb, seed, strict=True):
            left = differences(a[::-1], b[::-1], s[0], allowed, step)
            right = None if left is None else differences(c, d, s[-1], allowed - left, step)
            out.append(None if right is None else left + right)
        return pd.Series(out, dtype="Int32")

    span = F.length("seed") + F.least(F.length("left_a"), F.length("left_b")) + F.least(F.length("right_a"), F.length("right_b"))
    return pairs.withColumn("n_diff", count("left_a", "left_b", "right_a", "right_b", "seed")).where("n_diff is not null").withColumn("consis_len", span - F.col("n_diff"))


def flank_pairs(reads: DataFrame, k: int = K, queries: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """(qid, rid, strand) where the first k bases of a read (read_id, seq) stand in a query (the reads too, if not given), with the flanks of that seed.

    Queries and reads are told apart by read_id alone. Seeds that at least `most` reads begin with are repeats and left out, where that is given.
    """
    at = strands(reads if queries is None else queries).where(F.length("seq") > k).select(F.col("read_id").alias("qid"), "strand", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - k + 1)).alias("p")).withColumn("seed", F.expr(f"substr(seq, p, {k})"))
    first = reads.where(F.length("seq") > k).select(F.col("read_id").alias("rid"), F.substring("seq", 1, k).alias("seed"), F.expr(f"substr(seq, {k + 1})").alias("right_b"))
    if most is not None:
        first = first.join(first.groupBy("seed").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= most), "seed", "left_anti")
    return at.join(first, "seed").where("qid <> rid").select("qid", "rid", "strand", "seed", F.expr("substr(seq, 1, p - 1)").alias("left_a"), F.lit("").alias("left_b"), F.expr(f"substr(seq, p + {k})").alias("right_a"), "right_b")


def flank_pool(reads: DataFrame, targets: DataFrame, k: int = K) -> DataFrame:
    """(id, side, read_id, strand, ext): bases of reads beyond the last k bases of a target (id, seq), outwards.

    Side r is the end of the target, l its start seen on the other strand.
    """
    long = targets.where(F.length("seq") >= k)
    tails = long.select("id", F.lit("r").alias("side"), F.expr(f"right(seq, {k})").alias("seed")).union(long.select("id", F.lit("l"), revcomp(F.substring("seq", 1, k))))
    at = strands(reads).where(F.length("seq") > k).select("read_id", "strand", "seq", F.explode(F.sequence(F.lit(1), F.length("seq") - k)).alias("p")).withColumn("seed", F.expr(f"substr(seq, p, {k})"))
    return at.join(tails, "seed").select("id", "side", "read_id", "strand", F.expr(f"substr(seq, p + {k})").alias("ext"))


def extensions(pool: DataFrame, least: int = 2, share: float = 0.8) -> DataFrame:
    """(id, side, ext, support): what a pool agrees on beyond each end, base by base until fewer than `least` reads or `share` of them agree.

    Counts come before the strings, so an end holds a row a base of a read's length, however many reads reach it; support is
    the least number of agreeing reads. Ends without an agreed base have no row.
    """
    votes = pool.select("id", "side", F.posexplode(letters(F.col("ext"))).alias("p", "base")).groupBy("id", "side", "p", "base").agg(F.count(F.lit(1)).alias("n"))
    top = votes.groupBy("id", "side", "p").agg(F.max(F.struct("n", "base")).alias("t"), F.sum("n").alias("all"))
    rows = top.groupBy("id", "side").agg(F.sort_array(F.collect_list(F.struct("p", F.col("t.base").alias("base"), F.col("t.n").alias("n"), ((F.col("t.n") >= least) & (F.col("t.n") >= share * F.col("all"))).alias("ok")))).alias("way"))
    first_bad = F.array_position(F.transform("way", lambda x: x["ok"]), F.lit(False))
    kept = rows.withColumn("way", F.when(first_bad > 0, F.slice("way", F.lit(1), (first_bad - 1).cast("int"))).otherwise(F.col("way"))).where("size(way) > 0")
    return kept.select("id", "side", F.array_join(F.transform("way", lambda x: x["base"]), "").alias("ext"), F.array_min(F.transform("way", lambda x: x["n"])).alias("support"))


def mapped_groups(mapped: DataFrame, mates: DataFrame) -> DataFrame:
    """(group_id, id, line) of mapped reads (as align gives them) with mates (read_id, pair_id, mate).

    Targets that mates of one pair lie on are linked; a group is named after its smallest target, and a target without links
    is its own. Line: pair, mate, target, place, CIGAR and strand between tabs. Write it partitioned by group_id.
    """
    rows = mapped.join(mates, "read_id")
    far = rows.select("pair_id", F.col("mate").alias("m2"), F.col("id").alias("v"))
    links = rows.select("pair_id", "mate", F.col("id").alias("u")).join(far, "pair_id").where("mate < m2 and u <> v").select(F.least("u", "v").alias("u1"), F.greatest("u", "v").alias("u2")).distinct()
    named = rows.join(groups(links).withColumnRenamed("unitig", "id"), "id", "left")
    line = F.concat_ws("\t", *(F.col(c).cast("string") for c in ("pair_id", "mate", "id", "start", "cigar", "strand")))
    return named.select(F.coalesce("group_id", "id").alias("group_id"), "id", line.alias("line"))
