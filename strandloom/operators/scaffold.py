"""Order of linked unitigs and the sequences of scaffolds."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.plans.iterative import groups


def place(links: list[tuple], length: int = 100) -> dict[int, tuple[int, float, float]]:
    """(place in order, gap to the one before, deviation) of each unitig of one group of links (u1, u2, gap, sd, score).

    The link of the least score comes first; then always the link of the least score from a placed unitig to one that is
    not: that unitig lies a length and the gap to the right if the placed one is u1, to the left otherwise. Ties go to smaller ids.
    """
    near: dict[int, list] = {}
    for u1, u2, gap, sd, score in links:
        near.setdefault(u1, []).append((score, u1, u2, gap, sd, 1))
        near.setdefault(u2, []).append((score, u2, u1, gap, sd, -1))
    first = min(links, key=lambda x: (x[4], x[0], x[1]))[0]
    at, how, heap = {first: 0.0}, {first: 0.0}, list(near[first])
    heapq.heapify(heap)
    while heap:
        _, u, v, gap, sd, way = heapq.heappop(heap)
        if v not in at:
            at[v], how[v] = at[u] + way * (length + gap), sd
            for x in near[v]:
                heapq.heappush(heap, x)
    out, before = {}, None
    for k, u in enumerate(sorted(at, key=lambda u: (at[u], u)), 1):
        out[u] = (k, 0.0 if before is None else round(at[u] - at[before] - length, 6), round(how[u], 6))
        before = u
    return out


def _order(group: pd.DataFrame) -> pd.DataFrame:
    placed = place(list(group[["u1", "u2", "gap", "sd", "score"]].itertuples(index=False, name=None)))
    rows = [(group["group_id"].iloc[0], u, *x) for u, x in placed.items()]
    return pd.DataFrame(rows, columns=["group_id", "unitig", "ord", "gap", "sd"])


def order(gaps: DataFrame) -> DataFrame:
    """(group_id, unitig, ord, gap, sd) over estimated gaps (u1, u2, gap, sd, score), u1 to the left of u2, one row a pair.

    One task orders one group, whose links fit in its memory: they are one row a pair of unitigs, not a read.
    """
    label = groups(gaps.select("u1", "u2")).withColumnRenamed("unitig", "u1")
    kind = gaps.schema["u1"].dataType.simpleString()
    return gaps.join(label, "u1").groupBy("group_id").applyInPandas(_order, f"group_id {kind}, unitig {kind}, ord long, gap double, sd double")


def facing(mapped: DataFrame, mates: DataFrame, lengths: DataFrame) -> DataFrame:
    """(u, su, v, sv, gap, sd): unitigs, each with its strand, that the mates of a pair put one after the other, and the bases between.

    mapped (read_id, id, strand, start, len), mates (read_id, pair_id, mate, insert_size, insert_sd), lengths (id, whole).
    Mates face each other: the first lies on the strand su of u, the second on the other strand of v. The gap is the insert
    less what it covers of u to the right of the first mate's start and of v to the left of the second one's end.
    """
    at = mapped.join(mates, "read_id").join(lengths, "id")
    turned = F.col("whole") - F.col("start") - F.col("len")
    a = at.where("mate = 1").select("pair_id", F.col("id").alias("u"), F.col("strand").alias("su"), (F.col("whole") - F.when(F.col("strand") == "+", F.col("start")).otherwise(turned)).alias("cover_u"), "insert_size", "insert_sd")
    b = at.where("mate = 2").select("pair_id", F.col("id").alias("v"), F.when(F.col("strand") == "+", "-").otherwise("+").alias("sv"), (F.when(F.col("strand") == "-", F.col("start")).otherwise(turned) + F.col("len")).alias("cover_v"))
    gap = F.col("insert_size") - F.col("cover_u") - F.col("cover_v")
    return a.join(b, "pair_id").where("u <> v and insert_sd > 0").select("u", "su", "v", "sv", gap.cast("double").alias("gap"), F.col("insert_sd").cast("double").alias("sd"))


def strands(seen: DataFrame) -> DataFrame:
    """(unitig, strand) so that unitigs of a group lie as their pairs (u, su, v, sv) say.

    Each unitig is two nodes, one a strand; a pair links two of them and the other two. Of a unitig's nodes that with the
    smaller group counts; where pairs contradict each other both fall into one group and the strand is +.
    """
    node = lambda u, s: F.concat(F.col(u).cast("string"), s)
    other = lambda s: F.when(F.col(s) == "+", "-").otherwise("+")
    one = seen.select("u", "su", "v", "sv").distinct()
    both = one.select(node("u", F.col("su")).alias("u1"), node("v", F.col("sv")).alias("u2")).union(one.select(node("u", other("su")), node("v", other("sv"))))
    named = groups(both).select(F.expr("left(unitig, length(unitig) - 1)").alias("unitig"), F.expr("right(unitig, 1)").alias("strand"), "group_id")
    return named.groupBy("unitig").agg(F.min(F.struct("group_id", "strand")).alias("x")).select("unitig", F.col("x.strand").alias("strand"))


def estimates(seen: DataFrame, lie: DataFrame, least: int = 2) -> DataFrame:
    """(u1, u2, n, gap, sd, score) of pairs of unitigs that at least `least` pairs of mates link in one direction, u1 left of u2.

    Gaps are weighed by 1 / sd ** 2; score is the mean deviation from the estimate in units of sd. Pairs that contradict the
    strands chosen take no part; of two directions that with more pairs stays, then that with the smaller unitig first.
    """
    of = lambda u, s: lie.select(F.col("unitig").alias(u), F.col("strand").alias(s))
    laid = seen.join(of("u", "lu"), "u").join(of("v", "lv"), "v").where("(su = lu) = (sv = lv)")
    ahead = F.col("su") == F.col("lu")
    rows = laid.select(F.when(ahead, F.col("u")).otherwise(F.col("v")).alias("u1"), F.when(ahead, F.col("v")).otherwise(F.col("u")).alias("u2"), "gap", (1 / (F.col("sd") * F.col("sd"))).alias("w"))
    sums = rows.groupBy("u1", "u2").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("gap")).alias("wg"), F.sum(F.col("w") * F.col("gap") * F.col("gap")).alias("wgg")).where(F.col("n") >= least)
    mean = F.col("wg") / F.col("w")
    spread = F.greatest(F.col("wgg") - mean * F.col("wg"), F.lit(0.0))
    found = sums.select("u1", "u2", "n", F.round(mean, 6).alias("gap"), F.round(F.sqrt(1 / F.col("w")), 6).alias("sd"), F.round(F.sqrt(spread / F.col("n")), 6).alias("score"))
    best = found.groupBy(F.least("u1", "u2").alias("a"), F.greatest("u1", "u2").alias("b")).agg(F.min(F.struct((-F.col("n")).alias("few"), "u1", "u2", "n", "gap", "sd", "score")).alias("x"))
    return best.select("x.u1", "x.u2", "x.n", "x.gap", "x.sd", "x.score")


def sequences(ordered: DataFrame, unitigs: DataFrame) -> DataFrame:
    """(group_id, n_unitigs, seq): unitigs (unitig, seq) in order, an N for each base of a positive gap; unitigs without a sequence are left out."""
    parts = ordered.join(unitigs, "unitig").select("group_id", F.struct("ord", F.repeat(F.lit("N"), F.greatest(F.round("gap"), F.lit(0)).cast("int")).alias("n"), "seq").alias("x"))
    got = parts.groupBy("group_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    text = F.array_join(F.transform("xs", lambda x, i: F.concat(F.when(i == 0, "").otherwise(x["n"]), x["seq"])), "")
    return got.select("group_id", F.size("xs").alias("n_unitigs"), text.alias("seq"))
