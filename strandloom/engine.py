"""The stages from read files to scaffolds, each leaving its tables under one folder.

index: reads, counts, histogram. graph: simplified graph as vertices, links and their texts. map_reads: ways and places of
reads. overlaps: reads of a file against all reads. scaffold: order and sequences of linked unitigs. A stage reads what
earlier ones wrote, so it can run in another session; settings pass on in a manifest.
"""

from __future__ import annotations

import json
import time
import warnings
from contextlib import contextmanager
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.operators import alignment, libraries, scaffold
from strandloom.operators import graph as G
from strandloom.plans.iterative import _kept
from strandloom.sources.reads import parse_libraries, read_fastx
from strandloom.streaming.counts import kmer_counts

MAX_FREQ = 255
TABLES = ("reads", "kmers", "histogram", "vertices", "links", "vertex_text", "edge_text", "paths", "places", "overlaps", "order", "scaffolds", "stages")


@dataclass
class Settings:
    """K odd and from 33 to 255 (an even one goes up by one), quality 1 to 4, heterozygosity 1 to 3, genome size in millions of bases (0: unknown)."""

    k: int = 63
    quality: int = 3
    heterozygosity: int = 1
    min_freq: int = 2
    genome_size: int = 0

    def __post_init__(self) -> None:
        for name, value, low, high in (("K", self.k, 33, 255), ("quality", self.quality, 1, 4), ("heterozygosity", self.heterozygosity, 1, 3), ("min_freq", self.min_freq, 1, MAX_FREQ)):
            if not low <= value <= high:
                raise ValueError(f"{name} is {value}, not between {low} and {high}")
        self.k += 1 - self.k % 2


@dataclass(frozen=True)
class Curve:
    valley: int
    peak: int
    heterozygous: bool = False


def curve(counts: list[int]) -> Curve:
    """Valley and peak of a histogram, whose first entry is of (K+1)-mers seen once.

    The valley is the first entry below both neighbours, 20 at most. A peak stands above three rising entries before it and
    two falling after it; up to three count, none past three times the first. Of two, the second must be about twice the first.
    """
    n = dict(enumerate(counts, 1))
    valley = next((f for f in range(2, len(n)) if n[f - 1] > n[f] < n[f + 1]), 0)
    peaks: list[int] = []
    for p in range(max(valley + 1, 4), len(n) - 1):
        if n[p - 3] < n[p - 2] < n[p - 1] < n[p] > n[p + 1] > n[p + 2]:
            if len(peaks) == 3 or (peaks and p + 2 > 3 * peaks[0]):
                break
            peaks.append(p)
    if not 1 <= valley <= 20 or not peaks:
        raise ValueError("the histogram has no valley followed by a peak: too little coverage, or a mixture of genomes")
    if len(peaks) == 1:
        return Curve(valley, peaks[0])
    if abs(2 * peaks[0] - peaks[1]) < peaks[1] // 4:
        return Curve(valley, peaks[1], True)
    raise ValueError(f"peaks at {peaks} are not those of one diploid genome")


class Engine:
    """Stages over one folder that all executors reach: Engine(spark, out, settings).index(text).graph().map_reads().scaffold()."""

    def __init__(self, spark: SparkSession, out: str, settings: Settings | None = None):
        self.spark, self.out = spark, out.rstrip("/")
        if settings is None:
            self.manifest = json.loads("\n".join(r[0] for r in spark.read.text(f"{self.out}/manifest", wholetext=True).collect()))
            self.settings = Settings(**self.manifest["settings"])
        else:
            self.settings, self.manifest = settings, {"settings": asdict(settings)}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.out}/{name}")

    def _write(self, name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{self.out}/{name}")

    def _save_manifest(self) -> None:
        self.spark.createDataFrame([(json.dumps(self.manifest),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.out}/manifest")

    @contextmanager
    def _stage(self, name: str):
        began = time.time()
        yield
        self._save_manifest()
        self.spark.createDataFrame([(name, round(time.time() - began, 3))], "stage string, seconds double").write.mode("append").parquet(f"{self.out}/stages")

    def curve(self) -> Curve:
        return Curve(**self.manifest["curve"])

    def index(self, config: str) -> Engine:
        """Reads of the libraries of a text and counts of those that build contigs (asm_flag 1).

        read_id counts the records of a library file, or of a pair of files; pair_id is that of both mates.
        """
        with self._stage("index"):
            _, libs = parse_libraries(config)
            k = self.settings.k
            rows = libraries.prepared(libraries.records(self.spark, libs), libs, k, self.settings.quality)
            pair = F.concat_ws(":", "lib_id", "pair_file", "num")
            per_lib = lambda key: F.element_at(F.array(*(F.lit(lib[key]) for lib in libs)), F.col("lib_id") + 1).alias(key)
            self._write("reads", rows.select(F.concat_ws("/", pair, "mate").alias("read_id"), pair.alias("pair_id"), "mate", "lib_id", *(per_lib(c) for c in ("asm_flag", "seq_profile", "insert_size", "insert_sd")), "seq"))
            all_counts = _kept(kmer_counts(self.table("reads").where("asm_flag = 1"), k + 1))
            self._write("kmers", all_counts.where(F.col("n") >= self.settings.min_freq).select("kp1", F.least("n", F.lit(MAX_FREQ)).cast("int").alias("freq")))
            seen = all_counts.groupBy(F.least("n", F.lit(MAX_FREQ)).cast("int").alias("freq")).agg(F.count(F.lit(1)).alias("n"))
            whole = self.spark.range(1, MAX_FREQ + 1).select(F.col("id").cast("int").alias("freq")).join(seen, "freq", "left").select("freq", F.coalesce("n", F.lit(0)).alias("n"))
            self._write("histogram", whole.orderBy("freq").coalesce(1))
        return self

    def find_curve(self) -> Curve:
        """Valley and peak of the 255 rows of the histogram, and a warning where the peak doesn't fit a known genome size."""
        found = curve([r.n for r in self.table("histogram").orderBy("freq").collect()])
        if found.heterozygous and self.settings.heterozygosity < 3:
            self.settings.heterozygosity = 3
        if self.settings.genome_size:
            size = self.table("reads").where("asm_flag = 1").agg(F.sum(F.length("seq") - self.settings.k)).first()[0] or 0
            cover = size / (self.settings.genome_size * 1e6)
            if abs(found.peak - cover) > cover / 4:
                warnings.warn(f"the peak is at {found.peak}, but the reads cover the genome {cover:.1f} times", stacklevel=2)
        return found

    def graph(self, found: Curve | None = None) -> Engine:
        """The graph without tips and bubbles. A curve can be given where the histogram shows none."""
        with self._stage("graph"):
            found = found or self.find_curve()
            self.manifest |= {"settings": asdict(self.settings), "curve": asdict(found)}
            g = G.simplify(self.table("kmers"), found.valley, found.peak, self.settings.k)
            self._write("vertices", G.vertices(g))
            self._write("links", G.links(g))
            self._write("vertex_text", G.vertex_text(g))
            self._write("edge_text", G.edge_text(g))
            self._write("paths", G.read_paths(g, self.table("reads").select("read_id", "seq")))
        return self

    def map_reads(self) -> Engine:
        """Places of reads on vertices: with single-base gaps for libraries of profile 2."""
        with self._stage("map_reads"):
            reads, targets, k = self.table("reads"), self.table("vertices").select("id", "seq"), self.settings.k
            plain = alignment.align(reads.where("seq_profile = 1").select("read_id", "seq"), targets, k=k)
            gapped = alignment.align_gapped(reads.where("seq_profile = 2").select("read_id", "seq"), targets, k=k)
            cols = ["read_id", "id", "strand", F.col("start").cast("long").alias("start"), F.col("mismatches").cast("int").alias("mismatches"), "cigar"]
            self._write("places", plain.select(*cols, F.lit(0).alias("n_gaps")).union(gapped.select(*cols, "n_gaps")))
        return self

    def overlaps(self, path: str, seed: int = 20, allowed: int = 0) -> Engine:
        """Reads without N, longer than the seed, of a file against the prepared reads; seeds of repeats are left out."""
        with self._stage("overlaps"):
            asked = read_fastx(self.spark, path).where(~F.col("seq").rlike("[^ACGTacgt]")).select(F.col("name").alias("read_id"), F.upper("seq").alias("seq"))
            pairs = alignment.flank_pairs(self.table("reads").select("read_id", "seq"), seed, asked, 2 * self.curve().peak)
            self._write("overlaps", alignment.flanks(pairs, allowed).select("qid", "rid", "strand", "n_diff", "consis_len"))
        return self

    def scaffold(self, least: int = 2) -> Engine:
        """Order and sequences of unitigs that at least `least` pairs link, for paired libraries."""
        with self._stage("scaffold"):
            reads, v = self.table("reads"), self.table("vertices")
            span = F.aggregate(F.regexp_extract_all("cigar", F.lit(r"(\d+)[MUD]"), F.lit(1)), F.lit(0), lambda s, x: s + x.cast("int"))
            mapped = self.table("places").select("read_id", "id", "strand", "start", span.alias("len"))
            mates = reads.where("mate > 0 and asm_flag < 3").select("read_id", "pair_id", "mate", "insert_size", "insert_sd")
            seen = _kept(scaffold.facing(mapped, mates, v.select("id", F.col("len").alias("whole"))))
            lie = _kept(scaffold.strands(seen))
            self._write("order", scaffold.order(_kept(scaffold.estimates(seen, lie, least))))
            turned = v.join(lie, v["id"] == lie["unitig"]).select("unitig", F.when(F.col("strand") == "+", F.col("seq")).otherwise(G.revcomp(F.col("seq"))).alias("seq"))
            self._write("scaffolds", scaffold.sequences(self.table("order"), turned))
        return self
