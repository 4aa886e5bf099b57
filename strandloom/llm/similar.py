"""Near copies by exact similarity: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

An exact join by prefixes; no group is lost. Let every text's shingles stand in one common order. Sets of m and n
shingles at the similarity share at least 4/9 (m + n) of them, and so one among the first m - ceil(0.8 m) + 1 of the one
and the same of the other. Rows meet on such shingles, a cell each; a pair goes on if the sizes and the places of the
shingle allow the similarity, and is then verified over the whole sets. Any common order is exact, so shingles that a
sample of the rows holds often are put last: that only saves pairs.

A cell never sends on all its pairs. First every row is held against the smallest row of each of its cells, which is linear
and joins groups of copies, however large. Large cells that keep more than STRAYS rows outside their largest component are
then compared whole, inside tasks: cells of mostly the same rows become one group, a group is cut into tiles, and each pair
of tiles is a task's unit of work, which holds the rows' whole sets and counts what they share. A unit sends on a spanning
forest of the links that it finds, so its output grows with its rows and not with their pairs; its time still grows with
the rows outside the largest component times all rows of the group. In the cells that are left, which have at most
LARGE rows or at most STRAYS such rows, pairs of different components meet in a join if one row is not of the
cell's largest component and bit maps of their shingles leave room for the similarity: no pair is lost to that.

Shingles are 64-bit hashes of words cut as for op1's fingerprint; fewer words than a shingle give the whole sequence as
one; a text without a word is similar to none.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import only, picked, prepare, stored
from strandloom.llm.graph import components

#: Words of a shingle, seed of the word hash, one of so many rows sampled, rows of the sample that make a shingle common, most such.
WORDS, SEED, SAMPLE, OFTEN, COMMON = 5, 43, 8, 2, 400_000
#: Longs of a row's bit map, a power of two.
MAP = 8
MAPS = [f"map{k}" for k in range(MAP)]
#: Rows of a large cell, and those outside its largest component that a join may still hold against all of its rows.
LARGE, STRAYS = 64, 32
#: Rows of a tile, and shingles of one; a group of many rows has TILES tiles or as many as the shingles ask for.
TILE, TILE_SHINGLES, TILES = 128, 1 << 20, 15
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct hashes."""
    got = (text or "").encode().lower().split()
    if not got:
        return np.zeros(0, np.int64)
    words = np.frombuffer(b"".join([xxhash.xxh64_digest(w, SEED) for w in got]), np.uint64)
    n = min(WORDS, len(words))
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = h * FACTOR + words[k : k + len(h)]
    return np.unique(h.view(np.int64))


def _sets(batches):
    only()
    for b in batches:
        got = [shingles(t) for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["row"], pa.array(got, pa.list_(pa.int64()))], names=["row", "hashes"])


def _prefixes(batches, common):
    only()
    for b in batches:
        sizes, parts = [], []
        for t in b["text"].to_pylist():
            h = shingles(t)
            last = common[np.searchsorted(common[:-1], h)] == h
            sizes.append(len(h))
            parts.append(np.concatenate([h[~last], h[last]])[: len(h) - -(-4 * len(h) // 5) + 1])
        yield pa.RecordBatch.from_arrays([b["row"], pa.array(sizes, pa.int32()), pa.array(parts, pa.list_(pa.int64()))], names=["row", "n", "hashes"])


def _maps(batches):
    """A bit for each shingle of a row, by the shingle's last bits."""
    for b in batches:
        flags = np.zeros((b.num_rows, 64 * MAP), np.uint8)
        for k, t in enumerate(b["text"].to_pylist()):
            flags[k, shingles(t) & (64 * MAP - 1)] = 1
        got = np.packbits(flags, axis=1).view(np.int64)
        yield pa.RecordBatch.from_arrays([b["row"], *(pa.array(np.ascontiguousarray(got[:, k])) for k in range(MAP))], names=["row", *MAPS])


def sets(rows: DataFrame) -> DataFrame:
    """(row, hashes) of rows (row, text)."""
    prepare(rows.sparkSession)
    return rows.select("row", "text").mapInArrow(_sets, "row long, hashes array<long>")


def verified(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those pairs (u, v), each once, of rows (row, text), numbered and stored, that are at the similarity."""
    pairs = stored(pairs.select("u", "v"), "similar-pairs")
    ends = pairs.select(F.col("u").alias("row")).unionByName(pairs.select(F.col("v").alias("row"))).distinct()
    whole = stored(picked(rows, "row", ends, then=_sets, schema="row long, hashes array<long>"), "similar-sets")
    for s in "uv":
        pairs = pairs.join(whole.select(F.col("row").alias(s), F.col("hashes").alias(f"set_{s}")), s)
    shared = F.size(F.array_intersect("set_u", "set_v"))
    alike = (shared > 0) & (9 * shared >= 4 * (F.size("set_u") + F.size("set_v")))
    return stored(pairs.where(alike).select("u", "v"), "similar-links")


def prefixes(rows: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """(row, n, at, h, p): the shingles by which a row meets others, their places, the size of the row's set, and the
    smallest row (row, n, at) of the cell. Only cells of two rows or more; the rest ends in the one shuffle by shingle."""
    held = sets(rows.where(F.pmod(F.xxhash64("row"), F.lit(SAMPLE)) == 0)).select(F.explode("hashes").alias("h")).groupBy("h").count()
    common = held.where(F.col("count") >= OFTEN).orderBy(F.desc("count"), "h").limit(COMMON).select("h").toPandas()["h"].to_numpy(np.int64)
    common = np.append(np.sort(common), np.iinfo(np.int64).max)
    cut, kinds, rows = partial(_prefixes, common=common), "row long, n int, hashes array<long>", rows.select("row", "text")
    found = rows.mapInArrow(cut, kinds) if only is None else picked(rows, "row", only, then=cut, schema=kinds)
    cell = Window.partitionBy("h")
    spots = found.select("row", "n", F.posexplode("hashes").alias("at", "h"))
    spots = spots.withColumn("members", F.count(F.lit(1)).over(cell)).withColumn("p", F.min(F.struct("row", "n", "at")).over(cell))
    return stored(spots.where("members > 1").drop("members"), "similar-prefixes")


def _possible(n_a: Column, at_a: Column, n_b: Column, at_b: Column) -> Column:
    """Whether the sizes and a shared shingle's places leave room for the similarity, if no shared one comes before it."""
    return 9 * (1 + F.least(n_a - at_a - 1, n_b - at_b - 1)) >= 4 * (n_a + n_b)


def _candidates(meetings: DataFrame) -> DataFrame:
    """Pairs (u, v) that may be at the similarity, each once, of meetings (u, v, n_u, n_v, at_u, at_v), one for each shared shingle.

    What two sets share is what their prefixes share, and at most what is left of one of them.
    """
    left = lambda n: F.floor((4 * n + 4) / 5) - 1
    pairs = meetings.groupBy("u", "v").agg(F.count(F.lit(1)).alias("c"), F.bool_or(_possible(F.col("n_u"), F.col("at_u"), F.col("n_v"), F.col("at_v"))).alias("ok"), F.first("n_u").alias("n_u"), F.first("n_v").alias("n_v"))
    return pairs.where("ok").where(9 * (F.col("c") + F.greatest(left(F.col("n_u")), left(F.col("n_v")))) >= 4 * (F.col("n_u") + F.col("n_v"))).select("u", "v")


def _mixed(spots: DataFrame, joined: DataFrame) -> DataFrame:
    """(h, row, n, at, root, members, strays, largest, label) of spots in cells whose rows have different roots.

    largest: the root that most rows of the cell have; strays: how many rows have another. label: the least hash of its
    rows, which cells of mostly the same rows mostly share.
    """
    spots = spots.select("h", "row", "n", "at").join(joined.select(F.col("node").alias("row"), "component_id"), "row", "left").withColumn("root", F.coalesce("component_id", "row"))
    by_root = spots.groupBy("h", "root").agg(F.count(F.lit(1)).alias("members"), F.min(F.xxhash64("row")).alias("label"))
    cells = by_root.groupBy("h").agg(F.count(F.lit(1)).alias("roots"), F.max(F.struct("members", "root")).alias("most"), F.sum("members").alias("members"), F.min("label").alias("label")).where("roots > 1")
    cells = cells.select("h", "members", (F.col("members") - F.col("most.members")).alias("strays"), F.col("most.root").alias("largest"), "label")
    return stored(spots.join(cells, "h").select("h", "row", "n", "at", "root", "members", "strays", "largest", "label"), "similar-mixed")


class _Tile:
    """The sets of a tile's rows, to be held against one row at a time."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = np.array([len(x) for x in sets], np.int64)
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.n)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owner = flat[order], owner[order]

    def alike(self, one: np.ndarray) -> np.ndarray:
        """Positions of the rows whose sets are at the similarity to this one."""
        lo, hi = np.searchsorted(self.hashes, one, "left"), np.searchsorted(self.hashes, one, "right")
        many = hi - lo
        held = self.owner[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())]
        shared = np.bincount(held, minlength=len(self.n))
        return np.nonzero((shared > 0) & (9 * shared >= 4 * (len(one) + self.n)))[0]


def _forest(rows: list[int], roots: list[int], sets: list[np.ndarray], sides: list[np.ndarray], largest: int) -> list[tuple[int, int]]:
    """Links between rows of both sides (positions; one side: within it) that, with the roots, connect all rows at the similarity.

    Rows that are of the largest component already are not compared: a link of theirs is found by its other end, or joins
    two rows of that component.
    """
    up, out = {r: r for r in roots} | {largest: largest}, []

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    tiles = [_Tile([sets[k] for k in s]) for s in sides]
    for side, (other, tile) in zip(sides, zip(sides[::-1], tiles[::-1], strict=True), strict=True):
        for i in side.tolist():
            if find(roots[i]) != find(largest):
                for j in other[tile.alike(sets[i])].tolist():
                    a, b = find(roots[i]), find(roots[j])
                    if a != b:
                        up[a] = b
                        out.append((rows[i], rows[j]))
    return out


def _units(batches):
    only()
    for b in batches:
        for members, largest, ta, tb in zip(b["members"], b["largest"].to_pylist(), b["a"].to_pylist(), b["b"].to_pylist(), strict=True):
            got = members.values
            rows, roots, tile = (got.field(c).to_pylist() for c in ("row", "root", "tile"))
            hashes = got.field("hashes")
            ends, flat = hashes.offsets.to_numpy(), hashes.values.to_numpy()
            sets = [flat[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
            sides = [np.nonzero(np.array(tile) == k)[0] for k in sorted({ta, tb})]
            found = _forest(rows, roots, sets, sides, largest) if all(map(len, sides)) else []
            u, v = zip(*found, strict=True) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _compared(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Links (u, v) that connect all rows at the similarity which meet in these cells, as far as their roots don't."""
    cells = hot.select("h", "label", "members").distinct().groupBy("label").agg(F.sum(F.col("members") * F.col("members")).alias("pairs"))
    merged = hot.groupBy("label").agg(F.count_distinct("row").alias("rows")).join(cells, "label").where("rows * rows <= pairs").select("label", F.lit(True).alias("merged"))
    # cells with little in common but a row stay apart
    named = hot.join(merged, "label", "left").withColumn("name", F.when(F.col("merged"), F.col("label")).otherwise(F.col("h"))).select(F.coalesce("merged", F.lit(False)).alias("merged"), "name", "row", "root", "n").distinct()
    named = stored(named, "similar-named")
    by_root = named.groupBy("merged", "name", "root").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("shingles"))
    sizes = by_root.groupBy("merged", "name").agg(F.max(F.struct("rows", "root"))["root"].alias("largest"), F.sum("rows").alias("rows"), F.sum("shingles").alias("shingles"))
    tiles = F.greatest(F.least(F.ceil(F.col("rows") / TILE), F.lit(TILES)), F.ceil(F.col("shingles") / TILE_SHINGLES)).cast("int")
    named = named.join(sizes.select("merged", "name", "largest", tiles.alias("tiles")), ["merged", "name"])
    sets = stored(picked(rows, "row", named.select("row").distinct(), then=_sets, schema="row long, hashes array<long>"), "similar-hot-sets")
    named = named.withColumn("tile", F.pmod(F.xxhash64("row", F.lit(1)), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("tile")).alias("a"), F.greatest(o, F.col("tile")).alias("b")))
    units = named.join(sets, "row").select("merged", "name", "largest", "row", "root", "tile", "hashes", F.inline(pairs))
    units = units.groupBy("merged", "name", "largest", "a", "b").agg(F.collect_list(F.struct("row", "root", "tile", "hashes")).alias("members"))
    return stored(units.select("members", "largest", "a", "b").mapInArrow(_units, "u long, v long"), "similar-compared")


def _room() -> Column:
    """Whether rows _a and _b are of different components and their bit maps leave room for the similarity; never false for a pair at it.

    Bits that one map alone has are shingles that its set alone has, and the similarity leaves room for few.
    """
    alone = lambda x, y: sum((F.bit_count(F.col(f"{c}_{x}").bitwiseAND(F.bitwise_not(f"{c}_{y}"))) for c in MAPS[1:]), F.bit_count(F.col(f"{MAPS[0]}_{x}").bitwiseAND(F.bitwise_not(f"{MAPS[0]}_{y}"))))
    room = lambda x, y: 9 * (F.col(f"n_{x}") - alone(x, y)) >= 4 * (F.col("n_a") + F.col("n_b"))
    return (F.col("root_a") != F.col("root_b")) & room("a", "b") & room("b", "a")


def _side(spots: DataFrame, side: str, *more: str) -> DataFrame:
    return spots.select("h", *[F.col(c).alias(f"{c}_{side}") for c in ("row", "n", "at", "root", *more, *MAPS)])


def _sides(first: Column, a: str, b: str) -> list[Column]:
    """Columns u, v, n_u ... of meetings of rows a and b; u is row a where `first` holds."""
    return [F.when(first if s == "u" else ~first, F.col(f"{c}{a}")).otherwise(F.col(f"{c}{b}")).alias(s if c == "row" else f"{c}_{s}") for c in ("row", "n", "at") for s in "uv"]


def groups(rows: DataFrame, only: DataFrame | None = None, known: DataFrame | None = None) -> DataFrame:
    """(row, root) of rows (row, text), numbered and stored: equal roots for rows that links at the similarity connect.

    only: (row), the rows to take, if not all. known: links (u, v) at the similarity that were found before; they only save work.
    """
    spots = prefixes(rows, only)
    only = rows.select("row") if only is None else only
    # a row may meet its smallest one in some of their cells only, and so seem less similar: the second step finds what is lost here
    star = spots.where(F.col("row") > F.col("p.row")).select(F.col("p.row").alias("u"), F.col("row").alias("v"), F.col("p.n").alias("n_u"), F.col("n").alias("n_v"), F.col("p.at").alias("at_u"), F.col("at").alias("at_v"))
    links = verified(rows, _candidates(star))
    links = links if known is None else links.unionByName(known.select("u", "v"))
    joined = components(links)
    spots = _mixed(spots, joined)
    large = (F.col("strays") > STRAYS) & (F.col("members") > LARGE)
    hot = spots.where(large)
    if not hot.isEmpty():
        # pairs that meet in a large cell are done with, so the second step needs none of its spots
        links = links.unionByName(_compared(rows, hot))
        joined = components(links)
        spots = _mixed(spots.where(~large), joined)
    drawn = stored(picked(rows, "row", spots.select("row").distinct(), then=_maps, schema=", ".join(["row long", *(f"{c} long" for c in MAPS)])), "similar-maps")
    spots = stored(spots.join(drawn, "row").select("h", "row", "n", "at", "root", "largest", *MAPS), "similar-mapped")
    a, b = _side(spots, "a", "largest").where("root_a <> largest_a"), _side(spots, "b", "largest")
    fresh = (F.col("root_b") == F.col("largest_b")) | (F.col("row_a") < F.col("row_b"))  # each pair once a cell
    met = a.join(b, "h").where(fresh & _room())
    more = verified(rows, _candidates(met.select(*_sides(F.col("row_a") < F.col("row_b"), "_a", "_b"))))
    if not more.isEmpty():
        joined = components(links.unionByName(more))
    return only.join(joined.select(F.col("node").alias("row"), "component_id"), "row", "left").select("row", F.coalesce("component_id", "row").alias("root"))
