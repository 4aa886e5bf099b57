"""Best-fit packing of documents into sequences, improved by swaps between underfull bins.

Only lengths decide, so texts are encoded where they are read and only pieces (id, piece, start, length, checksum) go on.
Pieces are dealt at random into groups of a bounded number; each group is packed on its own by best fit, longest first,
and then by local search: moving a document, exchanging one for one, one for two or two for one, from an emptier bin to a
fuller one, which increases the sum of squared fills, so that the emptiest bins run dry. An index by free space finds the
exchange that takes most, among all underfull bins; the search ends when no exchange helps, or when the group uses as few
bins as any packing could (`lower_bound`). Groups are written, so that all readers of a plan see one plan.

Defined results: a null text is an empty one (the end id alone); null or repeated ids give their own pieces, row by row;
ties are broken by id and piece; an empty table gives an empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from functools import partial
from heapq import heapify, heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import prepare, stored, text_or_empty
from strandloom.llm.tokens import encoder

#: Pieces of a group, which is packed in one task.
GROUP = 40_000


def _pieces(batches, path, end_id, capacity, keep_ids):
    pack, tail, width = encoder(path).pack, struct.pack("<I", end_id), 4 * capacity
    for b in batches:
        rows = []
        for i, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True):
            raw = pack(t) + tail
            rows += [(i, k, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None) for k, at in enumerate(range(0, len(raw), width)) for part in (raw[at : at + width],)]
        if rows:
            cols = list(zip(*rows, strict=True))
            out = [pa.array(cols[0], b.schema.field("id").type), *(pa.array(c, t) for c, t in zip(cols[1:5], (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(out + [pa.array(cols[5], pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)


def lower_bound(lengths: list[int], capacity: int) -> int:
    """Bins that any packing needs. For each size s up to half a bin: documents over capacity - s share with none of s or
    more, those over half a bin with none of each other, and those from s to a half fill what the latter leave."""
    sizes = np.sort(np.asarray(lengths, np.int64))
    if not len(sizes):
        return 0
    total = np.concatenate([[0], np.cumsum(sizes)])
    half = np.searchsorted(sizes, capacity / 2, "right")
    small = np.arange(half + 1)  # documents from this place to half are counted as small
    size = np.where(small < half, sizes[np.minimum(small, len(sizes) - 1)], 0)
    big = np.where(small < half, np.searchsorted(sizes, capacity - size, "right"), len(sizes))
    left = total[half] - total[small] - ((big - half) * capacity - (total[big] - total[half]))
    return int((len(sizes) - half + np.maximum(0, -(-left // capacity))).max())


class _Index:
    """Underfull bins by what they could give back for more: nothing, one document or two, by length.

    most[k][y] is y plus the largest free space of a bin that can give y tokens, in k documents: what could come in for them.
    """

    def __init__(self, capacity: int):
        self.rooms: list[dict[int, list]] = [{}, {}]
        self.most = [np.full(capacity + 1, -1), np.full(capacity + 1, -1)]

    @staticmethod
    def _gives(lengths: list[int]):
        ones = sorted(set(lengths))
        yield 0, [0, *ones]
        yield 1, sorted({x + y for i, x in enumerate(ones) for y in ones[i:] if x != y or lengths.count(x) > 1})

    def add(self, k: int, lengths: list[int], free: int) -> None:
        for kind, sums in self._gives(lengths):
            for y in sums:
                insort(rooms := self.rooms[kind].setdefault(y, []), (free, k))
                self.most[kind][y] = y + rooms[-1][0]

    def remove(self, k: int, lengths: list[int], free: int) -> None:
        for kind, sums in self._gives(lengths):
            for y in sums:
                rooms = self.rooms[kind][y]
                del rooms[bisect_left(rooms, (free, k))]
                self.most[kind][y] = y + rooms[-1][0] if rooms else -1

    def best(self, lengths: list[int]) -> tuple[int, int, list[int], int, int] | None:
        """(gain, bin, documents out, kind and tokens back) of the exchange that takes most out of a bin of these lengths.

        One document moves, is exchanged for one or for two, or two are exchanged for one. Of bins the fullest is taken.
        """
        top = None
        for out, sums in self._gives(lengths):
            for x in sums:
                for kind in (0, 1 - out) if x else ():
                    if kind == out == 1:
                        continue
                    low = out  # two documents are not moved at once
                    here = np.flatnonzero(self.most[kind][low : min(x, len(self.most[kind]))] >= x)
                    if len(here) and (top is None or x - low - here[0] > top[0]):
                        y = int(low + here[0])
                        rooms = self.rooms[kind][y]
                        top = x - y, rooms[bisect_left(rooms, (x - y, -1))][1], (out, x), kind, y
        return top


def _take(lengths: list[int], kind: int, total: int) -> list[int]:
    """Takes one document, or two, of `total` tokens together out of a bin."""
    if not total:
        return []
    if not kind:
        lengths.remove(total)
        return [total]
    x = next(x for x in lengths if lengths.count(total - x) > (2 * x == total))
    lengths.remove(x)
    lengths.remove(total - x)
    return [x, total - x]


def improve(bins: list[list[int]], capacity: int, least: int) -> None:
    """Exchanges documents between underfull bins (ascending lengths), in place, until none helps or `least` bins are in use.

    The emptiest bin gives to fuller ones for as long as an exchange takes tokens out of it; each increases the sum of
    squared fills, so sweeps end. Every underfull bin is a source and a target, and every exchange of a kind is looked at.
    """
    fill = [sum(b) for b in bins]
    used = sum(map(bool, bins))
    changed = True
    while changed and used > least:
        changed, index = False, _Index(capacity)
        waiting = {k for k in range(len(bins)) if 0 < fill[k] < capacity}
        for k in waiting:
            index.add(k, bins[k], capacity - fill[k])
        heap = [(fill[k], k) for k in waiting]
        heapify(heap)
        while heap and used > least:
            size, a = heappop(heap)
            if a not in waiting or size != fill[a]:
                continue
            waiting.discard(a)
            index.remove(a, bins[a], capacity - fill[a])
            while fill[a] and (got := index.best(bins[a])):
                gain, t, (out, x), kind, y = got
                index.remove(t, bins[t], capacity - fill[t])
                there, back = _take(bins[a], out, x), _take(bins[t], kind, y)
                for n in there:
                    insort(bins[t], n)
                for n in back:
                    insort(bins[a], n)
                fill[a], fill[t], changed = fill[a] - gain, fill[t] + gain, True
                if fill[t] < capacity:
                    index.add(t, bins[t], capacity - fill[t])
                    heappush(heap, (fill[t], t))
                else:
                    waiting.discard(t)
            used -= not fill[a]


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of ascending lengths: each document, longest first, goes to the fullest bin that has room."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    frees: list[int] = []  # ascending, those of by_free
    for n in sorted(lengths, reverse=True):
        k = bisect_left(frees, n)
        if k == len(frees):
            at, free = len(bins), capacity
            bins.append([])
        else:
            free = frees[k]
            at = by_free[free].pop()
            if not by_free[free]:
                del by_free[free], frees[k]
        bins[at].append(n)
        if free > n:
            if free - n not in by_free:
                by_free[free - n] = []
                insort(frees, free - n)
            by_free[free - n].append(at)
    return [b[::-1] for b in bins]


def pack_lengths(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions in lengths."""
    where: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        where.setdefault(n, []).append(i)
    bins = best_fit(lengths, capacity)
    improve(bins, capacity, lower_bound(lengths, capacity))
    return [[where[n].pop() for n in b] for b in bins if b]


def _pack_group(group: pd.DataFrame, capacity: int) -> pd.DataFrame:
    group = group.sort_values(["id", "piece", "start", "length", "ids_crc32"], ignore_index=True)
    lengths = group["length"].tolist()
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    base = int(group["group"].iloc[0]) << 32
    for k, members in enumerate(pack_lengths(lengths, capacity)):
        at = 0
        for i in members:
            sequence[i], offset[i] = base + k, at
            at += lengths[i]
    return group.drop(columns="group").assign(sequence_id=sequence, offset=offset)


def pack(docs: DataFrame, path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, piece int, start long, length long, ids_crc32 long"
    pieces = stored(rows.mapInArrow(partial(_pieces, path=path, end_id=end_id, capacity=capacity, keep_ids=False), schema), "pieces")
    n = max(1, -(-pieces.count() // group))
    # rows without an id, or with the same one, are dealt by their place in the stored table
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(n)).cast("long"))
    packed = dealt.repartition(n, "group").groupBy("group").applyInPandas(partial(_pack_group, capacity=capacity), f"{schema}, sequence_id long, offset long")
    return stored(packed.withColumnRenamed("id", id_col), "packed")


def sequences(docs: DataFrame, plan: DataFrame, path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(sequence_id, n_tokens, ids as little-endian unsigned 32-bit bytes) of a plan over documents with unique ids.

    A sequence gathers capacity tokens at most.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    ids = rows.mapInArrow(partial(_pieces, path=path, end_id=end_id, capacity=capacity, keep_ids=True), f"id {dict(rows.dtypes)['id']}, piece int, start long, length long, ids_crc32 long, ids binary").select("id", "piece", "length", "ids")
    placed = ids.join(plan.select(F.col(id_col).alias("id"), "piece", "sequence_id", "offset"), ["id", "piece"])
    parts = placed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", "n_tokens", F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), "")).alias("ids"))
