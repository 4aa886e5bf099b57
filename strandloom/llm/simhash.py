"""Near-duplicate documents by 64-bit SimHash and pivot distance tables.

A document's fingerprint has a bit set where over half of its shingle hashes have it. Distinct fingerprints are linked
when at most `radius` (3) bits differ; documents of linked fingerprints form one component.

Candidates. A pivot table holds, for each fingerprint, its Hamming distances to many reference fingerprints. By the
triangle inequality a pair whose distances to any one reference differ by more than the radius is no pair, so the
largest coordinate difference discards pairs before they are compared. The table alone would still have to look at every
pair: a reference discards about half of unrelated pairs, whatever the number of rows. So rows first meet in cells: the
64 bits are cut into `radius + 2` blocks, of which two fingerprints within the radius share at least two, and there is a
cell for the bits of each pair of blocks. Inside a cell the table discards pairs and the survivors are compared.

Hot cells (thousands of near copies) are cut into tiles and each pair of tiles is a task's unit of work; a unit sends on
a spanning forest of its links, never the pairs. So memory and output are bounded by the tile, not by the group.

Defined results: a null or empty text, or one without a word, has fingerprint zero and is linked like any other; fewer
words than a shingle give the whole sequence as one; repeated rows and ids give a row each; rows with a null id get the
smallest id that they reach, null where no document of the component has one; an empty table gives an empty one; other
columns, whatever their names, are not read (`deduplicated` passes them on).
"""

from __future__ import annotations

from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import numbered, only, picked, prepare, stored, text_or_empty
from strandloom.llm.graph import components
from strandloom.llm.similar import groups, verified

#: References of the pivot table, fingerprints of a tile, seed of the shingle hash.
PIVOTS, TILE, SEED = 32, 2048, 42
REFERENCES = np.array([xxhash.xxh64_intdigest(f"pivot {k}") for k in range(PIVOTS)], np.uint64)


def fingerprint(text: str | None, words: int = 3) -> int:
    """Words are lower-cased in A-Z only and parted by ASCII white space."""
    got = (text or "").encode().lower().split()
    if not got:
        return 0
    joined, starts, at = b" ".join(got), [], 0
    for w in got:
        starts.append(at)
        at += len(w) + 1
    if len(got) <= words:
        shingles = [joined]
    else:
        ends = [s - 1 for s in starts[words:]] + [len(joined)]
        shingles = [joined[s:e] for s, e in zip(starts, ends, strict=False)]
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, 8)
    total = np.zeros(64, np.int64)
    for k in range(0, len(raw), 4096):
        total += np.unpackbits(raw[k : k + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(raw)).tobytes(), "big")


def _fingerprints(batches, words):
    only()
    for b in batches:
        got = np.array([fingerprint(t, words) for t in b["text"].to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(got, pa.int64())], names=["id", "fp"])


def _keyed(batches, words):
    only()
    for b in batches:
        got = np.array([fingerprint(t, words) for t in b["text"].to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b["id"], b["own"], b["key"], pa.array(got, pa.int64())], names=["row", "id", "key", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) with the 64 bits as a signed long."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(partial(_fingerprints, words=words), "id long, fp long")


def _pivot_table(fps: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ REFERENCES[None, :]).astype(np.int8)


def _links(fps: np.ndarray, other: np.ndarray, radius: int) -> np.ndarray:
    """Pairs of positions within the radius: sorted by the first pivot, discarded by the others, then compared."""
    table, against = _pivot_table(fps), _pivot_table(other)
    order, first = np.argsort(table[:, 0], kind="stable"), np.sort(table[:, 0])
    found = []
    for k in range(0, len(other), 256):
        part = against[k : k + 256]
        lo = np.searchsorted(first, part[:, 0].min() - radius, "left")
        hi = np.searchsorted(first, part[:, 0].max() + radius, "right")
        rows = order[lo:hi]
        a, b = np.nonzero(np.abs(table[rows, 0][:, None] - part[None, :, 0]) <= radius)
        for p in range(1, PIVOTS):
            keep = np.abs(table[rows[a], p] - part[b, p]) <= radius
            a, b = a[keep], b[keep]
        same = np.bitwise_count(fps[rows[a]] ^ other[k + b]) <= radius
        found.append(np.stack([rows[a[same]], k + b[same]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    """Those of the pairs that join what no pair before has joined."""
    root, out = list(range(n)), []

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _cells(batches, radius):
    """Spanning links of each cell or pair of tiles."""
    for b in batches:
        lists, tile_a, tile_b, out = b["members"].to_pylist(), b["a"].to_pylist(), b["b"].to_pylist(), []
        for members, ta, tb in zip(lists, tile_a, tile_b, strict=True):
            fps = np.array([m["fp"] for m in members], np.int64).view(np.uint64)
            reps = [m["rep"] for m in members]
            if ta == tb:
                pairs = _links(fps, fps, radius)
                pairs = pairs[pairs[:, 0] < pairs[:, 1]]
            else:
                side = np.array([m["tile"] for m in members])
                left, right = np.nonzero(side == ta)[0], np.nonzero(side == tb)[0]
                pairs = _links(fps[left], fps[right], radius)
                pairs = np.stack([left[pairs[:, 0]], right[pairs[:, 1]]], axis=1)
            out += [(reps[i], reps[j]) for i, j in _forest(len(reps), pairs)]
        if out:
            u, v = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def links(distinct: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """Links (u, v) between rows (fp, rep) within the radius that connect all such rows; each rep once."""
    blocks = radius + 2
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = [((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in range(blocks)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = [F.struct(F.lit(n).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(masks[i] | masks[j]))).alias("key")) for n, (i, j) in enumerate(combinations(range(blocks), 2))]
    rows = distinct.select("fp", "rep", F.inline(F.array(*keys)))
    sizes = rows.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, ["t", "key"]).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least(o, F.col("tile")).alias("a"), F.greatest(o, F.col("tile")).alias("b")))
    units = rows.select("t", "key", "fp", "rep", "tile", F.inline(pairs))
    units = units.groupBy("t", "key", "a", "b").agg(F.collect_list(F.struct("fp", "rep", "tile")).alias("members"))
    return units.select("a", "b", "members").mapInArrow(partial(_cells, radius=radius), "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 3) -> DataFrame:
    """(id, fp, component_id) of every row; component_id is the smallest id in reach, the row's own included."""
    prepare(docs.sparkSession)
    fps = stored(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = stored(fps.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    # classes go by their fingerprints; ids only name a component in the end, so any id will do, and none
    found = components(links(distinct.select("fp", F.col("fp").alias("rep")), radius))
    rooted = stored(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component_id", "fp").alias("root")), "fingerprint-roots")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(rooted.join(named, "root").select("fp", "component_id"), "fp", "left").select(F.col("id").alias(id_col), "fp", "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 3) -> DataFrame:
    """The documents, with all their columns, one of each group of near copies.

    Near copies are equal texts (null as empty) and texts whose five-word shingles have a similarity of at least 0.8; a
    group is what such links connect. The pivot tables find links, which are verified; `similar.groups` takes the verified
    ones and completes them, since at the similarity two fingerprints often differ in more bits than the radius. Of a
    group the smallest id stays, null being the largest, and of equal ids the first row. Rows are told apart by a number
    of their own, so null and repeated ids do no harm.
    """
    prepare(docs.sparkSession)
    docs, number = numbered(docs, "near-rows")
    rows = docs.select(F.col(number).alias("row"), text_or_empty(text_col).alias("text"))
    keys = docs.select(F.col(number).alias("id"), F.col(id_col).alias("own"), F.md5(text_or_empty(text_col).cast("binary")).alias("key"), text_or_empty(text_col).alias("text"))
    kind = dict(keys.dtypes)["own"]
    keyed = stored(keys.mapInArrow(partial(_keyed, words=words), f"row long, id {kind}, key string, fp long"), "near-keys")
    texts = stored(keyed.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("rank"), F.first("fp").alias("fp")).select(F.col("rank.row").alias("row"), "rank", "fp"), "near-texts")
    known = verified(rows, links(texts.select("fp", F.col("row").alias("rep")), radius).distinct())
    roots = groups(rows, texts.select("row"), known)
    kept = texts.join(roots, "row").groupBy("root").agg(F.min("rank").alias("rank")).select(F.col("rank.row").alias("row"))
    gone = keyed.select("row").join(kept, "row", "left_anti")
    return picked(docs, number, gone, keep=False).drop(number)
