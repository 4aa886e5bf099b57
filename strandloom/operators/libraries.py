"""Reads of libraries made ready for counting: the longest part without N, lengths, trimming and qualities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.dna import letters
from strandloom.plans.iterative import _kept
from strandloom.sources.reads import read_fastx

#: Bases that a read needs beyond K; the quality up to which a base is a poor one.
LEAST, POOR = 10, 10
#: Poor bases that the reads of a pair may have together, and the mean quality they need, for each level; level 4 takes all reads.
LEVELS = {1: (5, 25), 2: (2, 30), 3: (0, 35)}


def region(seq: Column) -> Column:
    """(len, start) of the longest part without N, the first of equally long ones; letters that are no bases are an error."""
    runs = F.split(F.when(seq.rlike("[^ACGTNacgtn]"), F.raise_error(F.concat(F.lit("not a base in "), seq))).otherwise(seq), "[Nn]")
    none = F.struct(F.lit(0).alias("len"), F.lit(0).alias("start"), F.lit(0).alias("pos"))
    longer = lambda s, r: F.length(r) > s["len"]
    step = lambda s, r: F.struct(F.greatest(s["len"], F.length(r)).alias("len"), F.when(longer(s, r), s["pos"]).otherwise(s["start"]).alias("start"), (s["pos"] + F.length(r) + 1).alias("pos"))
    return F.aggregate(runs, none, step)


def records(spark: SparkSession, libs: list[dict]) -> DataFrame:
    """(lib_id, pair_file, num, mate, seq, qual) of all files of libraries (sources.reads); files of a paired library alternate between mates."""
    parts = []
    for i, lib in enumerate(libs):
        if lib["paired"] and len(lib["files"]) % 2:
            raise ValueError(f"library {lib['name']} is paired and names an odd number of files")
        for j, path in enumerate(lib["files"]):
            pair, mate = (j // 2, j % 2 + 1) if lib["paired"] else (j, 0)
            parts.append(read_fastx(spark, path, numbered=True).select(F.lit(i).alias("lib_id"), F.lit(pair).alias("pair_file"), "num", F.lit(mate).alias("mate"), "seq", "qual"))
    return reduce(DataFrame.union, parts)


def prepared(rows: DataFrame, libs: list[dict], k: int, quality: int) -> DataFrame:
    """(lib_id, pair_file, num, mate, seq) of records that pass, upper case and without N.

    A part shorter than k + 10 goes, and its mate with it. Libraries of one length are cut to that of their first part long
    enough (of the second mate, where paired); shorter parts go. Qualities count over what is kept of both mates; reads
    without qualities pass. A mate without its partner in the other file goes too.
    """
    found = _kept(rows.withColumn("r", region(F.col("seq"))).select("lib_id", "pair_file", "num", "mate", F.upper(F.expr("substr(seq, r.start + 1, r.len)")).alias("seq"), F.expr("substr(qual, r.start + 1, r.len)").alias("qual")).where(F.length("seq") >= k + LEAST))
    same = [i for i, lib in enumerate(libs) if not lib["diverse_rd_len"]]
    if same:
        sizes = found.where(F.col("lib_id").isin(same) & F.col("mate").isin(0, 2)).groupBy("lib_id").agg(F.min_by(F.length("seq"), F.struct("pair_file", "num")).alias("size"))
        found = found.join(F.broadcast(sizes), "lib_id", "left").where("size is null or length(seq) >= size").select("lib_id", "pair_file", "num", "mate", *(F.when(F.col("size").isNull(), F.col(c)).otherwise(F.expr(f"substr({c}, 1, size)")).alias(c) for c in ("seq", "qual")))
    bases = [lib["qual_benchmark"] for lib in libs]
    offset = F.element_at(F.array(*(F.lit(b) for b in bases)), F.col("lib_id") + 1)
    scores = F.transform(letters(F.col("qual")), lambda c: F.ascii(c) - offset)
    judged = found.withColumn("q", scores)
    total, poor = F.aggregate("q", F.lit(0), lambda s, x: s + x), F.size(F.filter("q", lambda x: x <= POOR))
    judged = judged.select("lib_id", "pair_file", "num", "mate", "seq", total.alias("total"), F.when(F.col("q").isNotNull(), poor).alias("poor"), F.length("seq").alias("n"))
    key = ["lib_id", "pair_file", "num"]
    paired = [i for i, lib in enumerate(libs) if lib["paired"]]
    one = judged.where(~F.col("lib_id").isin(paired)) if paired else judged
    a, b = (judged.where(F.col("lib_id").isin(paired) & (F.col("mate") == m)) for m in (1, 2))
    both = a.join(b.select(*key, *(F.col(c).alias(f"{c}2") for c in ("seq", "total", "poor", "n"))), key)
    keep = lambda t, p, n: F.lit(True) if quality == 4 else t.isNull() | ((p <= LEVELS[quality][0]) & (t >= LEVELS[quality][1] * n))
    both = both.where(keep(F.col("total") + F.col("total2"), F.col("poor") + F.col("poor2"), F.col("n") + F.col("n2")))
    mates = both.select(*key, F.explode(F.array(F.struct(F.lit(1).alias("mate"), "seq"), F.struct(F.lit(2).alias("mate"), F.col("seq2").alias("seq")))).alias("x")).select(*key, "x.mate", "x.seq")
    return one.where(keep(F.col("total"), F.col("poor"), F.col("n"))).select(*key, "mate", "seq").union(mates)
