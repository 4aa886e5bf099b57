"""Benchmark decontamination by SimHash of item-sized windows, multi-index Hamming blocks and exact verification.

All steps are DataFrame operations. Words are runs of letters and digits in lower case; shingles are five words, or the
whole item where it has fewer. A window of a document has as many words as the item it is held against; a document with
fewer is one window. Similarity counts shingles as often as they occur: shared over those of either, at least 0.8.

1. Windows. At the similarity a window and an item of n words share c shingles, 9 c >= 4 (shingles of both). So only
   windows matter that have as many places with a shingle of some item of n words, wherever it stands in the item. The
   places are found by a scan that knows the benchmark's shingles (a literal set up to SET of them, a broadcast table up
   to BROADCAST, a merge join beyond); from the sorted places of a text follow, for each n, all such windows at every
   place of the text. Equal texts count once.
2. Fingerprints. A window's and an item's 64-bit SimHash over shingle hashes; counts of bits are kept in 32 lanes, two a
   long, which no text can overflow.
3. Multi-index. A fingerprint has BLOCKS blocks of 16 bits. Two that differ in at most RADIUS bits differ in at most
   FLIPS bits in one of them; an item is listed under all values of each block within FLIPS bits, and windows meet items
   in a join on (words of the item, block, bits). That finds every pair within the radius, while an unrelated pair meets
   in one of 25 cases.
4. Verification of the shingles themselves.

A window at the similarity of exactly 0.8 differs from its item in 9.7 of 64 bits on average; the radius of 15 holds 98 of
100 of these by the binomial law (measured: see README), more of nearer ones, and all equal windows. The work for one copy
of an item grows with the square of the item's words.

Defined results: null or empty texts and items without a word match nothing; repeated rows (same id and text) give their
matches once; rows with a null id are found like others; equal items each match; of a document and item the most similar
window counts, ties going to the first; an empty table gives an empty result; other columns, whatever their names, are
not read (`clean` passes them on).
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import prepare, stored, text_or_empty

#: Words of a shingle, least similarity, differing bits; shingles in a literal set and in a broadcast table (8 bytes each).
WORDS, SIMILARITY, RADIUS, SET, BROADCAST = 5, 0.8, 15, 50_000, 2_000_000
#: Blocks of a fingerprint, and the bits in which one of them differs at most.
BLOCKS = 4
FLIPS = RADIUS // BLOCKS


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _hash(array: Column | str, i: Column, n: int) -> Column:
    """Hash of n words from place i, from 0. Words are taken one by one: in a lambda a slice would copy the whole array."""
    return F.xxhash64(*[F.get(array, i + k) for k in range(n)])


def _at(n: int, known: list[int] | None = None):
    """Of a place in column w: the hash of n words from there, or whether it is known."""
    return (lambda i: _hash("w", i, n)) if known is None else (lambda i: _hash("w", i, n).isin(known))


def shingles(array: Column, n: int) -> Column:
    """Hashes of all runs of n words, in order; none where there are fewer."""
    runs = F.transform(F.sequence(F.lit(0), F.size(array) - n), lambda i: _hash(array, i, n))
    return F.when(F.size(array) >= n, runs).otherwise(F.array().cast("array<long>"))


def _lanes(h: str) -> list[Column]:
    """Sums of the bits of h, two to a long: bits k and k + 32."""
    both = F.lit((1 << 32) + 1)
    return [F.sum(F.shiftrightunsigned(h, k).bitwiseAND(both)).alias(f"lane{k}") for k in range(32)]


def _fingerprint(count: Column) -> Column:
    """Bits that over half of `count` hashes have."""
    bits = []
    for k in range(32):
        for half in (0, 32):
            ones = F.shiftrightunsigned(F.col(f"lane{k}"), half).bitwiseAND(F.lit(0xFFFFFFFF))
            bits.append(F.shiftleft((2 * ones > count).cast("long"), k + half))
    while len(bits) > 1:
        bits = [a.bitwiseOR(b) for a, b in zip(bits[::2], bits[1::2], strict=True)]
    return bits[0]


def _simhash(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, m, fp) of rows (keys, h); written, or the long expression would be repeated for each block."""
    sums = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"), *_lanes("h"))
    return stored(sums.select(*keys, "m", _fingerprint(F.col("m")).alias("fp")), "bench-fingerprints")


def _blocks(fp: str) -> Column:
    """(block, bits) of the blocks of a fingerprint."""
    size = 64 // BLOCKS
    return F.inline(F.array(*[F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(fp, k * size).bitwiseAND(F.lit((1 << size) - 1)).alias("bits")) for k in range(BLOCKS)]))


def _flips() -> Column:
    """All masks of at most FLIPS bits of a block."""
    size = 64 // BLOCKS
    masks = [sum(1 << b for b in bits) for n in range(FLIPS + 1) for bits in combinations(range(size), n)]
    return F.explode(F.array(*[F.lit(m).cast("long") for m in masks]))


def _needed(shingles_of_both: Column) -> Column:
    """Shared shingles that the similarity takes: with s = c / (both - c), c = both s / (1 + s)."""
    return F.ceil(shingles_of_both * (SIMILARITY / (1 + SIMILARITY)) - 1e-9)


def _items(benchmark: DataFrame, item_col: str, item_text: str) -> DataFrame:
    """(row, item, n, g, hashes): words of an item, words of its shingles, and these in order."""
    items = benchmark.select(F.col(item_col).alias("item"), words(text_or_empty(item_text)).alias("w")).where(F.size("w") > 0)
    items = stored(items.select(F.monotonically_increasing_id().alias("row"), "item", F.size("w").alias("n"), F.least(F.size("w"), F.lit(WORDS)).alias("g"), "w"), "bench-words")
    by_size = [items.where(F.col("g") == g).select("row", "item", "n", "g", shingles(F.col("w"), g).alias("hashes")) for g in range(1, WORDS + 1)]
    return stored(reduce(DataFrame.unionByName, by_size), "bench-items")


def _near(rows: DataFrame, items: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """Those rows (id, key, w) that hold a shingle of the benchmark where a similar window must have one."""
    # of m shingles of a similar window at most m (1 - s) / (1 + s) are not the item's, so some run of this many is: one look a run finds it
    # (a window of a shorter document has one shingle less at the same loss, or loses less)
    lost = F.floor((F.col("n") - F.col("g") + 1) * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9)
    runs = {r.g: int(r.run) for r in items.groupBy("g").agg(F.min(F.greatest(F.lit(1), F.ceil((F.col("n") - F.col("g") - lost) / (lost + 1)))).alias("run")).collect()}
    places = lambda g: F.when(F.size("w") >= g, F.sequence(F.lit(0), F.size("w") - g, F.lit(runs[g]))).otherwise(F.array().cast("array<int>"))
    known = grams.select("g", "h").distinct()
    n = known.count()
    if n <= SET:
        sets = {g: [r.h for r in known.where(F.col("g") == g).collect()] for g in sizes}
        return rows.where(reduce(Column.__or__, [F.exists(places(g), _at(g, sets[g])) for g in sizes]))
    held = None
    for g in sizes:
        one = known.where(F.col("g") == g).select("h")
        looks = rows.select("id", "key", F.explode(F.transform(places(g), _at(g))).alias("h"))
        hit = looks.join(F.broadcast(one) if n <= BROADCAST else one, "h", "left_semi").select("id", "key")
        held = hit if held is None else held.unionByName(hit)
    return rows.alias("r").join(held.distinct().alias("k"), (F.col("r.key") == F.col("k.key")) & F.col("r.id").eqNullSafe(F.col("k.id")), "left_semi")


def _starts(near: DataFrame, grams: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, g, n, start): windows of texts (key, len, h1 ...) with enough places that hold a shingle of some item of n words."""
    spots = reduce(DataFrame.unionByName, [near.select("key", "len", F.lit(g).alias("g"), F.posexplode(f"h{g}").alias("pos", "h")) for g in sizes])
    hits = spots.join(grams.select("g", "h", "n").distinct(), ["g", "h"]).groupBy("key", "len", "g", "n").agg(F.sort_array(F.collect_list("pos")).alias("places"))
    hits = hits.withColumn("m", F.least("n", "len") - F.col("g") + 1).withColumn("need", _needed(F.col("m") + F.col("n") - F.col("g") + 1).cast("int"))
    # need places in a row that lie in one window: it starts at the first of them at most, and holds the last
    runs = hits.where(F.size("places") >= F.col("need")).select("key", "len", "g", "n", "m", F.explode(F.transform(F.sequence(F.lit(1), F.size("places") - F.col("need") + 1), lambda i: F.struct(F.element_at("places", i).alias("a"), F.element_at("places", i + F.col("need") - 1).alias("b")))).alias("run"))
    lo, hi = F.greatest(F.lit(0), F.col("run.b") - F.col("m") + 1), F.least(F.col("run.a"), F.greatest(F.lit(0), F.col("len") - F.col("n")))
    return runs.select("key", "g", "n", lo.alias("lo"), hi.alias("hi")).where("lo <= hi").select("key", "g", "n", F.explode(F.sequence("lo", "hi")).alias("start")).distinct()


def _matches(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text: str) -> tuple[DataFrame, DataFrame] | None:
    """Rows (id, key) near the benchmark, and (key, item, start, n_words, similarity) of their texts; None for a benchmark without words.

    rows: (id, key, text), key being a digest of the text.
    """
    items = _items(benchmark, item_col, item_text)
    grams = stored(items.select("row", "n", "g", F.explode("hashes").alias("h")), "bench-shingles")
    sizes = sorted(r.g for r in grams.select("g").distinct().collect())
    if not sizes:
        return None
    # the row number, kept until the hits are written, keeps the filter of _near from moving under this projection, where it
    # would cut the words anew for each shingle
    rows = rows.select("id", "key", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    hits = stored(_near(rows, items, grams, sizes), "bench-hits")
    near = hits.dropDuplicates(["key"])
    near = stored(near.select("key", F.size("w").alias("len"), *[shingles(F.col("w"), g).alias(f"h{g}") for g in sizes]), "bench-near")

    part = F.lit(None).cast("array<long>")
    for g in sizes:
        part = F.when(F.col("g") == g, F.slice(F.col(f"h{g}"), F.col("start") + 1, F.col("n") - g + 1)).otherwise(part)
    windows = stored(_starts(near, grams, sizes).join(near, "key").select("key", "n", "start", part.alias("hashes")), "bench-windows")

    keys = ["key", "n", "start"]
    window_fp = _simhash(windows.select(*keys, F.explode("hashes").alias("h")), keys)
    item_fp = _simhash(grams.select("row", "n", "h"), ["row", "n"]).select("row", "n", F.col("m").alias("item_m"), F.col("fp").alias("item_fp"), _blocks("fp"))
    listed = item_fp.select("row", "n", "item_m", "item_fp", "block", "bits", _flips().alias("flip")).withColumn("bits", F.col("bits").bitwiseXOR(F.col("flip"))).drop("flip")
    # the list is 2,788 rows an item, which its estimated size doesn't show: it is never broadcast
    pairs = window_fp.select(*keys, "m", "fp", _blocks("fp")).join(listed.hint("merge"), ["n", "block", "bits"])
    pairs = pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select(*keys, "m", "item_m", "row").distinct()

    in_window = windows.select(*keys, F.explode("hashes").alias("h")).groupBy(*keys, "h").agg(F.count(F.lit(1)).alias("a"))
    in_item = grams.groupBy("row", "h").agg(F.count(F.lit(1)).alias("b"))
    shared = pairs.join(in_window, keys).join(in_item, ["row", "h"])
    scored = shared.groupBy(*keys, "row", "m", "item_m").agg(F.sum(F.least("a", "b")).alias("c"))
    scored = scored.withColumn("similarity", F.col("c") / (F.col("m") + F.col("item_m") - F.col("c"))).where(F.col("similarity") >= SIMILARITY)
    best = scored.groupBy("key", "row").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"), (F.col("m") + F.least("n", F.lit(WORDS)) - 1).cast("int").alias("n"))).alias("b"))
    found = best.join(items.select("row", "item"), "row").select("key", "item", (-F.col("b.s")).alias("start"), F.col("b.n").alias("n_words"), F.col("b.similarity").alias("similarity"))
    return hits.select("id", "key"), stored(found, "bench-matches")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.md5(text_or_empty(text_col).cast("binary")).alias("key"), text_or_empty(text_col).alias("text"))


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item, start, n_words, similarity) for each document and item with a window of at least the similarity.

    start: the window's first word in the document, from 0; n_words: the window's words, fewer than the item's where the document has fewer.
    """
    prepare(docs.sparkSession)
    got = _matches(_keyed(docs, id_col, text_col), benchmark, item_col, item_text)
    if got is None:
        kinds = {"id": dict(docs.dtypes)[id_col], "item": dict(benchmark.dtypes)[item_col]}
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {kinds['id']}, `{item_col}` {kinds['item']}, start int, n_words int, similarity double")
    rows, found = got
    return rows.distinct().join(found, "key").select(F.col("id").alias(id_col), F.col("item").alias(item_col), "start", "n_words", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that match no item. A row goes by its own text, whatever its id, or none."""
    prepare(docs.sparkSession)
    got = _matches(_keyed(docs, id_col, text_col), benchmark, "item_id", "text")
    if got is None:
        return docs
    leaked = stored(got[1].select(F.col("key").alias("leaked")).distinct(), "bench-leaks")
    return docs.join(leaked, F.md5(text_or_empty(text_col).cast("binary")) == leaked["leaked"], "left_anti")
