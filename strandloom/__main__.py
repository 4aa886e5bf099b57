"""python -m strandloom STAGE: index, graph, map, overlap, scaffold or all; tables go to OUT/PREFIX."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from strandloom.engine import Engine, Settings


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="strandloom")
    stages = p.add_subparsers(dest="stage", required=True)
    for name in ("index", "graph", "map", "overlap", "scaffold", "all"):
        s = stages.add_parser(name)
        s.add_argument("-p", dest="prefix", default="strandloom", help="name of the folder of tables")
        s.add_argument("-o", dest="out", default=".", help="folder in which it lies")
        s.add_argument("-N", dest="cores", type=int, help="cores, where Spark runs on this machine")
        s.add_argument("-M", dest="memory", type=int, help="memory in GB, where Spark runs on this machine")
        if name in ("index", "all"):
            s.add_argument("-c", dest="config", required=True, help="library file")
            s.add_argument("-K", dest="k", type=int, default=63)
            s.add_argument("-q", dest="quality", type=int, default=3)
            s.add_argument("-H", dest="heterozygosity", type=int, default=1)
            s.add_argument("-G", dest="genome_size", type=int, default=0, help="millions of bases")
        if name == "overlap":
            s.add_argument("-f", dest="file", required=True, help="reads to look for")
            s.add_argument("-s", dest="seed", type=int, default=20)
            s.add_argument("-d", dest="allowed", type=int, default=0, help="bases that may differ")
        if name in ("scaffold", "all"):
            s.add_argument("-l", dest="least", type=int, default=2, help="pairs that a link needs")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> None:
    a = arguments(argv)
    builder = SparkSession.builder.appName("strandloom")
    if a.cores:
        builder = builder.master(f"local[{a.cores}]")
    if a.memory:
        builder = builder.config("spark.driver.memory", f"{a.memory}g")
    spark = builder.getOrCreate()
    out = f"{a.out.rstrip('/')}/{a.prefix}"
    if a.stage in ("index", "all"):
        config = "\n".join(r[0] for r in spark.read.text(a.config, wholetext=True).collect())
        engine = Engine(spark, out, Settings(a.k, a.quality, a.heterozygosity, genome_size=a.genome_size)).index(config)
    else:
        engine = Engine(spark, out)
    if a.stage in ("graph", "all"):
        engine.graph()
    if a.stage in ("map", "all"):
        engine.map_reads()
    if a.stage == "overlap":
        engine.overlaps(a.file, a.seed, a.allowed)
    if a.stage in ("scaffold", "all"):
        engine.scaffold(a.least)


if __name__ == "__main__":
    main()
