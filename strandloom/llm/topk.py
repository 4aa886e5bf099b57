"""Exact top-k by inner product, pruned by segment statistics from coarse to fine.

A vector is cut into 1, 4 and 16 segments; each has a mean and a deviation. The distance of two vectors is at least
what their segments' means and deviations leave, which for inner products reads: at most the sum over segments of
length x (product of means + product of deviations). Candidates whose bound falls below a query's threshold are
discarded, level by level; survivors get their exact integer score.

Thresholds: the k-th best exact score of a query among SAMPLE rows drawn by hash is written beside the query, and every
task starts from it; a sample only ever makes a threshold lower than the true one, so no row is lost to it. A task holds up
to HELD candidates, ordered by the means of their segments and cut into tiles; a tile as a whole has a bound from the
ranges of its statistics, so tiles far from a query aren't touched. Tiles are taken best bound first and raise the
threshold as they go. A task sends on only rows that reach the query's threshold, k for each query at most.

Queries are a table in the shared folder that every task reads once for HELD candidates, block by block, so neither
side is broadcast or crossed as rows. Where bounds can't tell vectors apart (unclustered ones), what is left is nearly all
pairs, and their scores come from a matrix product: the work is queries x rows then.

Scores are exact for components of any size: rows with components over 2^53 / dimensions (as a product) are multiplied as
whole numbers of any length. A score beyond 64 bits counts as the largest or smallest long.

Defined results: vectors that are null or hold a null or non-finite component take no part, nor do rows with a null id;
shorter vectors count as padded with zeros; rows with the query's id are its own; repeated query ids count once (smallest
vector); ties go to smaller ids; an empty table gives an empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import file_system, prepare, shared_dir, stored

#: Candidates that a task holds, of a tile, and queries of a block; segments of the levels; rows of the sample.
HELD, TILE, QUERIES, LEVELS, SAMPLE = 1 << 16, 2048, 512, (1, 4, 16), 4096
#: Share of pairs from which a whole matrix product is the cheaper way; pairs taken singly at a time.
DENSE, BATCH = 0.03, 1 << 16
LONG = (1 << 63) - 1


def scaled(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(vec_id, v) with floor(scale * x) of each component, whole numbers as doubles, of the rows that take part."""
    limit = F.lit(float("inf"))
    fine = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()).where(fine)
    # a double of 2^53 or more is whole already, and its floor as a long could be cut off
    floor = lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(vec_col, lambda x: floor(x.cast("double") * scale)).alias("v"))


def _matrix(lists) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    values, ends = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    values, ends = values[ends[0] : ends[-1]], ends - ends[0]
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(values)) - np.repeat(ends[:-1], sizes)] = values
    return out


def _pad(m: np.ndarray, d: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, d - m.shape[1])))


def _stats(m: np.ndarray, level: int) -> np.ndarray:
    """Means, then deviations, of the segments, weighted so that a product of two rows is the bound."""
    edges = np.linspace(0, m.shape[1], min(level, m.shape[1]) + 1).astype(int)
    parts = [(m[:, a:b], np.sqrt(b - a)) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return np.stack([p.mean(axis=1) * root for p, root in parts] + [p.std(axis=1) * root for p, root in parts], axis=1)


def _wide(m: np.ndarray, d: int) -> np.ndarray:
    """Rows whose products may not be exact as doubles."""
    return np.abs(m).max(axis=1, initial=0) ** 2 * d >= 1 << 53


def _whole(m: np.ndarray) -> np.ndarray:
    return np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)


class Candidates:
    """Vectors (ids ascending for ties) in an order that keeps like segment means together, with statistics of rows and tiles."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        d = max(m.shape[1], 1)
        m = _pad(m, d)
        wide = _wide(m, d)
        self.wide_ids, self.wide = ids[wide], _whole(m[wide])
        ids, m = ids[~wide], m[~wide]
        means = _stats(m, 4)[:, : min(4, d)]
        spread = means.std(axis=0)
        order = np.lexsort((ids, *np.floor(means / np.where(spread > 0, spread, 1)).T[::-1])) if len(ids) else np.zeros(0, int)
        self.ids, self.m, self.d = ids[order], m[order], d
        self.levels = [level for level in LEVELS if level < d] or [1]
        self.stats = [_stats(self.m, level) for level in self.levels]
        self.tiles = [(a, min(a + TILE, len(ids))) for a in range(0, len(ids), TILE)]
        s = self.stats[min(1, len(self.stats) - 1)]
        half = s.shape[1] // 2
        self.low = np.array([s[a:b, :half].min(axis=0) for a, b in self.tiles]).reshape(-1, half)
        self.high = np.array([s[a:b, :half].max(axis=0) for a, b in self.tiles]).reshape(-1, half)
        self.most = np.array([s[a:b, half:].max(axis=0) for a, b in self.tiles]).reshape(-1, half)

    def tile_bounds(self, stats: np.ndarray) -> np.ndarray:
        """What a query and any row of a tile can reach, from the ranges of the tile's means and deviations."""
        half = stats.shape[1] // 2
        mean, dev = stats[:, None, :half], stats[:, None, half:]
        return (np.maximum(mean * self.low, mean * self.high) + dev * self.most).sum(axis=2)


def best(q_ids: np.ndarray, q: np.ndarray, held: Candidates, k: int, least: np.ndarray | None = None):
    """Rows (query, vec_id, score) that may be among the k best of their query, k of each at most, and how many pairs were scored.

    least: thresholds to start from; rows below them are left out, rows that reach them are not.
    """
    d = max(q.shape[1], held.d)
    if d > held.d:  # longer queries: the padding adds nothing to a product
        q, d = q[:, : held.d], held.d
    q = _pad(q, d)
    least = np.full(len(q_ids), -np.inf) if least is None else least.astype(float).copy()
    found, scored = [], 0
    wide = _wide(q, d)
    fine = np.nonzero(~wide)[0]
    if len(held.ids) and len(fine):
        rows, n = _best_fine(q_ids[fine], q[fine], held, k, least[fine])
        found.append((fine[rows[0]], rows[1], rows[2].astype(object)))
        scored += n
    for at, ids, a, b in ((np.arange(len(q_ids)), held.wide_ids, q, held.wide), (np.nonzero(wide)[0], held.ids, q[wide], held.m)):
        if len(at) and len(ids):
            exact = _whole(a) @ (b if b.dtype == object else _whole(b)).T
            i, j = np.nonzero((q_ids[at][:, None] != ids[None, :]) & (exact >= least[at][:, None]))
            found.append((at[i], ids[j], exact[i, j]))
            scored += exact.size
    if not found:
        return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64), scored
    i, ids, score = (np.concatenate([f[c] for f in found]) for c in range(3))
    score = np.array([max(-LONG - 1, min(LONG, int(s))) for s in score], np.int64)
    order = np.lexsort((ids, np.invert(score), i))  # ~score descends and can't overflow
    i, ids, score = i[order], ids[order], score[order]
    keep = np.arange(len(i)) - np.searchsorted(i, i, "left") < k
    return i[keep], ids[keep], score[keep], scored


def _best_fine(q_ids, q, held, k, least):
    """best() of rows whose products are exact as doubles."""
    stats = [_stats(q, level) for level in held.levels]
    reach = held.tile_bounds(stats[min(1, len(stats) - 1)])
    slack = 1 + 1e-9 * np.abs(reach).max(initial=0)
    top = np.full((len(q), k), -np.inf)
    found, scored = [], 0
    for t in np.argsort(-reach.max(axis=0)):
        rows = np.nonzero(reach[:, t] + slack >= least)[0]
        if not len(rows):
            continue
        a, b = held.tiles[t]
        alive, pairs = (q_ids[rows][:, None] != held.ids[None, a:b]), None
        for sq, sc in zip(stats, held.stats, strict=True):
            if pairs is None:
                alive &= sq[rows] @ sc[a:b].T + slack >= least[rows][:, None]
                if alive.mean() <= DENSE:
                    pairs = np.nonzero(alive)
            else:
                i, j = pairs
                keep = np.concatenate([np.zeros(0, bool)] + [np.einsum("ij,ij->i", sq[rows[i[x : x + BATCH]]], sc[a + j[x : x + BATCH]]) + slack >= least[rows[i[x : x + BATCH]]] for x in range(0, len(i), BATCH)])
                pairs = i[keep], j[keep]
        if pairs is None:
            score = np.where(alive, q[rows] @ held.m[a:b].T, -np.inf)
            scored += int(alive.sum())
        else:
            i, j = pairs
            score = np.full((len(rows), b - a), -np.inf)
            for x in range(0, len(i), BATCH):
                score[i[x : x + BATCH], j[x : x + BATCH]] = np.einsum("ij,ij->i", q[rows[i[x : x + BATCH]]], held.m[a + j[x : x + BATCH]])
            scored += len(i)
        n = min(k, b - a)
        top[rows] = -np.sort(-np.concatenate([top[rows], np.partition(score, b - a - n, axis=1)[:, b - a - n :]], axis=1), axis=1)[:, :k]
        least[rows] = np.maximum(least[rows], top[rows, k - 1])
        i, j = np.nonzero(np.isfinite(score) & (score >= least[rows][:, None]))
        found.append((rows[i], held.ids[a + j], score[i, j].astype(np.int64)))
    if not found:
        return (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64)), scored
    i, ids, score = (np.concatenate([f[c] for f in found]) for c in range(3))
    keep = score >= least[i]
    return (i[keep], ids[keep], score[keep]), scored


def _load(batches) -> Candidates:
    table = pa.Table.from_batches(batches).combine_chunks()
    ids, m = table["vec_id"].to_numpy(), _matrix(table["v"].combine_chunks())
    order = np.argsort(ids, kind="stable")
    return Candidates(ids[order], m[order])


def _query_blocks(folder, columns):
    import pyarrow.dataset as ds

    store, path = file_system(folder)
    for part in ds.dataset(path, filesystem=store, format="parquet").to_batches(columns=columns, batch_size=QUERIES):
        if part.num_rows:
            yield part


def _thresholds(batches, sample, k):
    """Of each query the k-th best score among the sample; none where it holds too few others."""
    held = None
    for b in batches:
        held = held or _load(list(_query_blocks(sample, ["vec_id", "v"])) or [pa.RecordBatch.from_pydict({"vec_id": [], "v": []}, schema=pa.schema([("vec_id", pa.int64()), ("v", pa.list_(pa.float64()))]))])
        least = np.full(b.num_rows, -np.inf)
        i, _, score, _ = best(b["vec_id"].to_numpy(), _matrix(b["v"]), held, k)
        last = np.nonzero(np.arange(len(i)) - np.searchsorted(i, i, "left") == k - 1)[0]
        least[i[last]] = score[last]  # as a double it may lie a little above the score; one step down is safe
        least[i[last]] = np.nextafter(least[i[last]], -np.inf)
        yield pa.RecordBatch.from_arrays([b["vec_id"], b["v"], pa.array(least)], names=["vec_id", "v", "least"])


def _search(batches, queries, k):
    def block(rows):
        held = _load(rows)
        for part in _query_blocks(queries, ["vec_id", "v", "least"]):
            q_ids = part["vec_id"].to_numpy()
            i, ids, score, _ = best(q_ids, _matrix(part["v"]), held, k, part["least"].to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[i]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    rows, n = [], 0
    for b in batches:
        if b.num_rows:
            rows.append(b)
            n += b.num_rows
        if n >= HELD:
            yield from block(rows)
            rows, n = [], 0
    if rows:
        yield from block(rows)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """(query_id, rank, vec_id, score): for rows where is_query holds, the k best of all other rows."""
    spark = vectors.sparkSession
    prepare(spark)
    rows, drawn, asked = scaled(vectors, id_col, vec_col, scale), shared_dir(spark, "topk-sample"), shared_dir(spark, "topk-queries")
    n = max(1, rows.count())
    rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 40)) < int((1 << 40) * min(1, sample / n))).write.parquet(drawn)
    queries = scaled(vectors.where(is_query), id_col, vec_col, scale).groupBy("vec_id").agg(F.min("v").alias("v"))
    queries.mapInArrow(partial(_thresholds, sample=drawn, k=k), "vec_id long, v array<double>, least double").write.parquet(asked)
    found = stored(rows.mapInArrow(partial(_search, queries=asked, k=k), "query_id long, vec_id long, score long"), "topk-found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
