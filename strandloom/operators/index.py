"""Numbers in a global order, suffixes and their columns, places of positions, and counts of windows of long texts.

Nothing here meets in one task: rows are cut into ranges, sorted within them, and what comes before a range is a sum over
one row a range.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.plans.iterative import _kept
from strandloom.plans.views import BASES, K, UPPER

#: Positions of a bin of a range join; letters of a piece of a text; bases that the LCP flag looks at.
BIN, PIECE, FLAG = 1024, 1 << 20, K + 1
#: Bits of a number that count rows within a range.
ROWS = 33
#: Bases whose hash deals windows out (four of them fill a run's 128 bits); windows of a run, all of which hold the same one if they are neighbours.
MINIMIZER, RUN = 16, K + 1 - 15
#: Shares of a part; times that a row of a run stands for at most; bytes of text of a part; runs that are taken apart at once, and runs held before equal ones become one.
SHARES, MOST, PART, SLICE, HELD = 256, (1 << 11) - 1, 8 << 20, 1 << 16, 1 << 20


def in_order(df: DataFrame, *keys: Column | str) -> DataFrame:
    """The rows with part and at: their range and their place in it, from 0, in the order of keys (which should tell rows apart)."""
    ranges = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = _kept(df.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()))
    return rows.withColumn("part", F.shiftright("place", ROWS)).withColumn("at", F.col("place").bitwiseAND(F.lit((1 << ROWS) - 1))).drop("place")


def before(rows: DataFrame, measure: Column, *by: str) -> DataFrame:
    """(part, by, before): the sum of a measure over all earlier ranges, for each value of `by`. One row a range and value."""
    parts = rows.groupBy("part", *by).agg(measure.cast("long").alias("n"))
    earlier = Window.partitionBy(*by).orderBy("part") if by else Window.orderBy("part")
    return parts.select("part", *by, (F.sum("n").over(earlier) - F.col("n")).alias("before"))


def numbered(df: DataFrame, name: str, *keys: Column | str) -> DataFrame:
    """The rows with their number in the order of keys, from 1; part stays."""
    rows = in_order(df, *keys)
    return rows.join(F.broadcast(before(rows, F.count(F.lit(1)))), "part").withColumn(name, F.col("before") + F.col("at") + 1).drop("before", "at")


def suffixes(reads: DataFrame) -> DataFrame:
    """(rid, off, suffix, bwt) of reads (rid, seq): every suffix with its end marker, and the letter before it."""
    spots = reads.select("rid", "seq", F.explode(F.sequence(F.lit(0), F.length("seq"))).alias("off"))
    return spots.select("rid", "off", F.expr("substr(concat(seq, '$'), off + 1)").alias("suffix"), F.when(F.col("off") == 0, "$").otherwise(F.expr("substr(seq, off, 1)")).alias("bwt"))


def suffix_array(found: DataFrame) -> DataFrame:
    """(isa, rid, off, bwt, prefix, part) of suffixes in the order of bases, the end marker first and ties by read."""
    order = F.translate("suffix", "$CATG", "01234")
    return numbered(found.select("rid", "off", "bwt", F.substring("suffix", 1, FLAG).alias("prefix"), order.alias("order")), "isa", "order", "rid").drop("order")


def occurrences(sa: DataFrame) -> DataFrame:
    """(isa, bwt, occ): how often a row's letter stands in the column up to it."""
    sa = _kept(sa.select("isa", "bwt", "part"))
    here = F.count(F.lit(1)).over(Window.partitionBy("part", "bwt").orderBy("isa").rowsBetween(Window.unboundedPreceding, 0))
    return sa.withColumn("here", here).join(F.broadcast(before(sa, F.count(F.lit(1)), "bwt")), ["part", "bwt"]).select("isa", "bwt", (F.col("here") + F.col("before")).alias("occ"))


def last_to_first(occ: DataFrame) -> DataFrame:
    """(isa, lf): the row of a row's letter in the first column."""
    occ = _kept(occ)
    letters = occ.groupBy("bwt").agg(F.count(F.lit(1)).alias("n"))  # five rows
    smaller = letters.select("bwt", F.coalesce(F.sum("n").over(Window.orderBy(F.translate("bwt", "$CATG", "01234")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return occ.join(F.broadcast(smaller), "bwt").select("isa", (F.col("occ") + F.col("before")).alias("lf"))


def lcp_flags(sa: DataFrame) -> DataFrame:
    """(isa, lcp): whether a suffix starts with the same K + 1 letters as the one before it."""
    sa = _kept(sa.select("isa", "prefix", "part"))
    lasts = sa.groupBy("part").agg(F.max_by("prefix", "isa").alias("last"))
    lasts = lasts.select("part", F.lag("last").over(Window.orderBy("part")).alias("last"))
    inside = F.lag("prefix").over(Window.partitionBy("part").orderBy("isa"))
    return sa.withColumn("inside", inside).join(F.broadcast(lasts), "part").select("isa", F.coalesce(F.col("prefix") == F.coalesce("inside", "last"), F.lit(False)).alias("lcp"))


def offsets(reads: DataFrame, key: str, length: Column) -> DataFrame:
    """(key, start, end) of reads laid end to end in the order of a key."""
    rows = in_order(reads.select(key, length.cast("long").alias("length")), key)
    here = F.sum("length").over(Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    ends = rows.withColumn("here", here).join(F.broadcast(before(rows, F.sum("length"))), "part").withColumn("end", F.col("here") + F.col("before"))
    return ends.select(key, (F.col("end") - F.col("length")).alias("start"), "end")


def locate(positions: DataFrame, laid: DataFrame, key: str) -> DataFrame:
    """(pos, key, off) of positions in reads laid end to end (key, start, end): a join by bins, then by place."""
    bins = laid.where("end > start").select(key, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / BIN), F.floor((F.col("end") - 1) / BIN))).alias("bin"))
    return positions.withColumn("bin", F.floor(F.col("pos") / BIN)).join(bins, "bin").where("pos >= start and pos < end").select("pos", key, (F.col("pos") - F.col("start")).alias("off"))


_CODES = np.full(256, 255, np.uint8)
for _letter, _base in zip(UPPER, BASES, strict=True):
    _CODES[[ord(_letter), ord(_letter.lower())]] = "ACGT".index(_base)


def _numbers(x: np.ndarray, size: int, kind=np.uint64) -> np.ndarray:
    """Every window of `size` bases as a number: windows of 1, 2, 4, ... bases, joined."""
    width, step, whole, have = x.astype(kind), 1, None, 0
    while step <= size:
        if size & step:
            whole = width if whole is None else (width[: len(whole) - step] << kind(2 * have)) + whole[step:]
            have += step
        width, step = (width[:-step] << kind(2 * step)) + width[step:], 2 * step
    return whole


def _canonical(batches):
    """Every canonical window of K + 1 bases as two numbers of half its bases each, window by window: what the counts are held against."""
    half = (K + 1) // 2
    for b in batches:
        found = []
        for text in b["text"].to_pylist():
            codes = _CODES[np.frombuffer((text or "").encode(), np.uint8)]
            codes = codes[codes < 4]
            for at in range(0, max(0, len(codes) - K), PIECE):
                x = codes[at : at + PIECE + K]
                ahead, back = _numbers(x, half), _numbers(3 - x[::-1], half)[::-1]  # back[i]: the reverse complement of the half at i
                a, b2 = ahead[:-half], ahead[half:]
                c, d = back[half:], back[:-half]
                turned = (c < a) | ((c == a) & (d < b2))
                found.append(np.stack([np.where(turned, c, a), np.where(turned, d, b2)]))
        both = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(both[0].astype(np.int64)), pa.array(both[1].astype(np.int64))], names=["hi", "lo"])


def _u(x: int) -> np.uint64:
    return np.uint64(x)


def _runs(codes: np.ndarray, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, hi, lo) of runs of windows that share their least hash of a MINIMIZER, at most RUN windows each.

    whole: whether the window at a place lies within one text. A hash is that of the smaller strand, so it is the same
    wherever and however a window stands. hi and lo hold the bases from the top, and the number of windows in the last bits.
    """
    n = len(whole)
    ahead = _numbers(np.concatenate([codes, np.zeros(4 * MINIMIZER, np.uint8)]), MINIMIZER, np.uint32)
    back = _numbers(3 - codes[::-1], MINIMIZER, np.uint32)[::-1]
    least = (np.minimum(ahead[: len(back)], back) ^ np.uint32(0x5BD1E995)) * np.uint32(0x9E3779B1)
    step = 1
    while 2 * step <= RUN:
        least, step = np.minimum(least[:-step], least[step:]), 2 * step
    least = np.minimum(least[:n], least[RUN - step : RUN - step + n])
    first = np.concatenate([[True], (least[1:] != least[:-1]) | (whole[1:] != whole[:-1])])
    start = np.nonzero(first)[0]
    size = np.diff(start, append=n)[whole[start]]
    start = start[whole[start]]
    parts = -(-size // RUN)
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start, size = np.repeat(start, parts) + nth * RUN, np.minimum(np.repeat(size, parts) - nth * RUN, RUN).astype(np.uint64)
    hi, lo = ((ahead[start + k].astype(np.uint64) << _u(32)) | ahead[start + k + MINIMIZER] for k in (0, 2 * MINIMIZER))
    bases = size + _u(K - 2 * MINIMIZER)  # of lo
    return least[start], hi, lo >> (_u(64) - _u(2) * bases) << (_u(64) - _u(2) * bases) | size


def _dealt(batches, parts):
    """Runs of windows of texts, equal ones of a piece as one, a row for each part that holds some: the numbers of _runs, one after the other."""
    for b in batches:
        found = [_CODES[np.frombuffer((t or "").encode(), np.uint8)] for t in b["text"].to_pylist()]
        found = [x[x < 4] for x in found]
        ends = np.cumsum([len(x) for x in found], dtype=int)
        codes = np.concatenate([np.zeros(0, np.uint8), *found])
        del found
        for at in range(0, max(0, len(codes) - K), PIECE):
            x = codes[at : at + PIECE + K]
            whole = np.ones(len(x) - K, bool)
            for k in range(1, K + 1):  # windows over an end
                over = ends - at - k
                whole[over[(over >= 0) & (over < len(whole))]] = False
            if not whole.any():
                continue
            key, hi, lo = _runs(x, whole)
            part, lo = key % np.uint32(parts), lo | (key // np.uint32(parts) % np.uint32(SHARES)).astype(np.uint64) << _u(16)
            order = np.lexsort((lo, hi, part))
            part, hi, lo = part[order], hi[order], lo[order]
            new = np.nonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))[0]
            times = np.diff(new, append=len(hi))
            rows = -(-times // MOST)
            nth = np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
            times = np.minimum(np.repeat(times, rows) - nth * MOST, MOST).astype(np.uint64)
            new = np.repeat(new, rows)
            part, both = part[new], np.stack([hi[new], lo[new] | times << _u(5)], axis=1).astype("<u8")
            cuts = np.nonzero(np.concatenate([[True], part[1:] != part[:-1]]))[0]
            blobs = [both[i:j].tobytes() for i, j in zip(cuts, [*cuts[1:], len(part)], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts].astype(np.int32)), pa.array(blobs, pa.binary())], names=["part", "runs"])


def _turned(x: np.ndarray) -> np.ndarray:
    """The complement of 32 bases, the last first."""
    x = ~x
    for bits, mask in ((2, 0x3333333333333333), (4, 0x0F0F0F0F0F0F0F0F)):
        x = ((x >> _u(bits)) & _u(mask)) | ((x & _u(mask)) << _u(bits))
    return x.byteswap()


def _windows(hi: np.ndarray, lo: np.ndarray, times: np.ndarray, share: int, shares: int):
    """(top, low, times) of the canonical windows of runs: their first two bases and the other 32; with shares, of one share of them."""
    size, back_hi, back_lo = lo & _u(31), _turned(lo & _u(~0xFFFFFF % (1 << 64))), _turned(hi)
    out = []
    for k in range(RUN):
        if k:
            held = size > _u(k)
            hi, lo, back_hi, back_lo, size, times = hi[held], lo[held], back_hi[held], back_lo[held], size[held], times[held]
        # the window k places in: from the top of the run, and as many places from the end of the turned run
        top, low = (hi >> _u(60 - 2 * k)) & _u(15), (hi << _u(4 + 2 * k)) | (lo >> _u(60 - 2 * k))
        top2, low2 = (back_hi >> _u(2 * k)) & _u(15), (back_lo >> _u(2 * k)) | (back_hi << _u(64 - 2 * k) if k else _u(0))
        turned = (top2 < top) | ((top2 == top) & (low2 < low))
        top, low = np.where(turned, top2, top).astype(np.uint8), np.where(turned, low2, low)
        mine = slice(None) if shares == 1 else (low * _u(0x9E3779B97F4A7C15) >> _u(40)) % _u(shares) == _u(share)
        out.append((top[mine], low[mine], times[mine]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _merged(hi: np.ndarray, lo: np.ndarray, times: np.ndarray):
    """Equal runs as one."""
    order = np.lexsort((lo, hi))
    hi, lo, times = hi[order], lo[order], times[order]
    new = np.nonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))[0]
    return hi[new], lo[new], np.add.reduceat(times, new)


def _counted(batches):
    """(hi, lo, n) of the distinct windows of the runs of a task, some at a time; equal windows have equal hashes, so they all are here."""
    none = np.zeros(0, np.uint64)
    held, new, size, limit = (none, none, none), [], 0, HELD
    for b in batches:
        for blob in b["runs"]:
            new.append(np.frombuffer(blob.as_buffer(), "<u8"))
            size += len(new[-1]) // 2
            if len(held[0]) + size > limit:
                held = _merged(*_joined(held, new))
                new, size, limit = [], 0, max(HELD, 2 * len(held[0]))
    hi, lo, times = _joined(held, new)
    del held, new
    share = (lo >> _u(16)) & _u(SHARES - 1)
    order = np.argsort(share.astype(np.uint16), kind="stable")
    hi, lo, times = hi[order], lo[order], times[order]
    ends = np.cumsum(np.bincount(share.astype(int), minlength=SHARES))
    at = 0
    while at < len(hi):
        end = int(max(ends[np.searchsorted(ends, at, "right")], ends[max(0, np.searchsorted(ends, at + SLICE, "right") - 1)]))
        shares = -(-(end - at) // (2 * SLICE))
        for k in range(shares):
            got = [_windows(hi[i : min(i + SLICE, end)], lo[i : min(i + SLICE, end)], times[i : min(i + SLICE, end)], k, shares) for i in range(at, end, SLICE)]
            top, low, n = (np.concatenate(x) for x in zip(*got, strict=True))
            for t in range(16):
                mine = np.nonzero(top == t)[0]
                if len(mine):
                    x = low[mine]
                    order = np.argsort(x)
                    x = x[order]
                    first = np.nonzero(np.concatenate([[True], x[1:] != x[:-1]]))[0]
                    x, total = x[first], np.add.reduceat(n[mine][order], first)
                    yield (x >> _u(34)) + _u(t << 30), x & _u((1 << 34) - 1), total
        at = end


def _joined(held, new):
    """Runs with their times apart: those held and those of new blobs."""
    both = np.concatenate([np.zeros(0, np.uint64), *new]).reshape(-1, 2)
    return tuple(np.concatenate(x) for x in zip(held, (both[:, 0], both[:, 1] & _u(~(MOST << 5) % (1 << 64)), (both[:, 1] >> _u(5)) & _u(MOST)), strict=True))


def _count_rows(batches):
    for hi, lo, n in _counted(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (hi, lo, n)], names=["hi", "lo", "n"])


def _count_hist(batches, most):
    hist = np.zeros(most + 1, np.int64)
    for _, _, n in _counted(batches):
        hist += np.bincount(np.minimum(n, _u(most)).astype(int), minlength=most + 1)
    freq = np.nonzero(hist)[0]
    yield pa.RecordBatch.from_arrays([pa.array(freq.astype(np.int32)), pa.array(hist[freq])], names=["freq", "n"])


def _text_runs(texts: DataFrame) -> DataFrame:
    """Runs of windows of texts, one task's for each part of the windows: as many parts as hold PART bytes of text each."""
    spark = texts.sparkSession
    for name, bound in (("maxRecordsPerBatch", 4096), ("maxBytesPerBatch", 16 << 20)):  # frames are lazy: the bounds stay in the session
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= bound:
            spark.conf.set(key, str(bound))
    parts = 1 + (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART
    return texts.select("text").mapInArrow(partial(_dealt, parts=parts), "part int, runs binary").repartitionById(parts, "part")


def text_window_counts(texts: DataFrame) -> DataFrame:
    """(hi, lo, n) of the canonical (K+1)-mers that the letters of texts stand for.

    Neighbouring windows mostly share the least hash of the MINIMIZERs in them; such runs are dealt out by that hash as their
    bases, two bits each, and taken apart where they are counted.
    """
    return _text_runs(texts).mapInArrow(_count_rows, "hi long, lo long, n long")


def text_window_hist(texts: DataFrame, most: int) -> DataFrame:
    """(freq, n): how many canonical (K+1)-mers of texts occur so often; `most` stands for all above."""
    return _text_runs(texts).mapInArrow(partial(_count_hist, most=most), "freq int, n long").groupBy("freq").agg(F.sum("n").alias("n"))
