"""Token-id files in Simple-8b words.

A file holds documents in ascending id order. Layout, little-endian:
  magic "S8B1", then blocks, then the directory, then a footer (directory offset, blocks, documents, ids: 4 x u64; magic).
  A block codes up to BLOCK ids as 64-bit words: the top 4 bits select how many ids the word packs and of how many bits.
  An id that no selector holds is an escape: selector 15 with the id in the low 60 bits.
  The directory has, for each block, its byte offset, its words and its ids, and for each document its id and ids.
Ids of one block decode together: all words of a selector at once, whatever their place.

Whole files are written under a name of the attempt and moved into place, so a lost executor or a doubled task leaves
no half file; a shard is read by ranges, never as a whole.

Defined results: a null text is an empty one and gives the end id alone; rows with a null id come first, with equal ids
in the order of the rows read; an empty table gives no files and no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import file_system, prepare, read_range, shared_dir, stored, text_or_empty, write_bytes
from strandloom.llm.tokens import encoder

MAGIC = b"S8B1"
#: Ids of a block, which decodes on its own; ids aimed at in a file; ids that a reader gathers before it sends them on.
BLOCK, FILE_IDS, HELD = 1024, 16 << 20, 1 << 20
#: Bytes of a text that make about one id; rows sampled for each file's bounds, and for all of them.
ID_BYTES, SAMPLE_PART, SAMPLE = 4, 100, 1 << 21
# Fixed values: (ids in a word, bits of each) by selector, widest first; selector 15 is the escape.
SELECTORS = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 59)]
ESCAPE = 15


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks one after the other, and the number of words of each block.

    The best selector is found for every place at once; the places where words start then step forward in all blocks
    together, and all words of a selector are packed together.
    """
    ids = np.ascontiguousarray(ids)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start = np.arange(0, n, BLOCK)
    end = np.minimum(start + BLOCK, n)
    room = np.repeat(end, end - start) - np.arange(n)  # ids left in the block
    choice = np.full(n, ESCAPE, np.int8)
    for s in range(len(SELECTORS) - 1, -1, -1):  # the selector that packs most ids wins
        count, bits = SELECTORS[s]
        if n < count:
            continue
        over = np.zeros(n + 1, np.int32)
        np.cumsum(ids >= 1 << bits if bits < 8 * ids.dtype.itemsize else np.zeros(n, bool), out=over[1:])
        choice[: n - count + 1][(over[count:] == over[:-count]) & (room[: n - count + 1] >= count)] = s
    counts = np.array([c for c, _ in SELECTORS] + [1, 1], np.int64)
    at, stop, places = start, end, []
    while len(at):
        places.append(at)
        at = at + counts[choice[at]]
        live = at < stop
        if not live.all():
            at, stop = at[live], stop[live]
    places = np.sort(np.concatenate(places))
    sel, words = choice[places], np.zeros(len(places), np.uint64)
    for s in np.unique(sel):
        m = np.nonzero(sel == s)[0]
        count, bits = SELECTORS[s] if s != ESCAPE else (1, 60)
        value = np.full(len(m), int(s) << 60, np.uint64)
        for j in range(count):
            value |= ids[places[m] + j].astype(np.uint64) << np.uint64(j * bits)
        words[m] = value
    return words, np.bincount(places // BLOCK, minlength=len(start))


def decode(words: np.ndarray) -> np.ndarray:
    """Ids of words, selector by selector."""
    words = np.asarray(words, dtype=np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in SELECTORS] + [1, 1], np.int64)[sel]
    first = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for s in np.unique(sel):
        m = np.nonzero(sel == s)[0]
        count, bits = SELECTORS[s] if s != ESCAPE else (1, 60)
        mask = np.uint64((1 << bits) - 1)
        for j in range(count):
            out[first[m] + j] = words[m] >> np.uint64(j * bits) & mask
    return out


def file_parts(docs: list[tuple[int, int]], ids: np.ndarray, group: int = 1024):
    """The bytes of a file of documents (id, number of ids), a group of blocks at a time."""
    yield MAGIC
    at, entries = 4, []
    for k in range(0, len(ids), group * BLOCK):
        part = ids[k : k + group * BLOCK]
        words, sizes = encode(part)
        yield words.astype("<u8").tobytes()
        lengths = np.full(len(sizes), BLOCK)
        lengths[-1] = len(part) - BLOCK * (len(sizes) - 1)
        entries.append(np.stack([at + 8 * (np.cumsum(sizes) - sizes), sizes, lengths], axis=1))
        at += 8 * len(words)
    blocks = np.concatenate(entries) if entries else np.zeros((0, 3))
    yield blocks.astype("<u8").tobytes()
    yield np.array([x for d in docs for x in d], dtype="<i8").tobytes()
    yield struct.pack("<4Q", at, len(blocks), len(docs), len(ids)) + MAGIC


def directory(uri: str) -> tuple[np.ndarray, np.ndarray]:
    """Of a file: (offset, words, ids) of its blocks and (id, ids) of its documents."""
    store, path = file_system(uri)
    size = store.get_file_info(path).size
    at, blocks, docs, _ = struct.unpack("<4Q", (tail := read_range(uri, size - 36, 36))[:32])
    if tail[32:] != MAGIC:
        raise ValueError(f"{uri} is not a whole file of this format")
    raw = read_range(uri, at, 24 * blocks + 16 * docs)
    return np.frombuffer(raw[: 24 * blocks], "<u8").reshape(-1, 3).astype(np.int64), np.frombuffer(raw[24 * blocks :], "<i8").reshape(-1, 2)


def read_ids(uri: str, group: int = 512):
    """(id, ids) of each document of a file in order, reading a group of blocks at a time."""
    blocks, docs = directory(uri)
    left, held, b = [], 0, 0
    for doc_id, n in docs:
        while held < n:
            part = blocks[b : b + group]
            raw = read_range(uri, int(part[0, 0]), int(8 * part[:, 1].sum()))
            left.append(decode(np.frombuffer(raw, "<u8")))
            held, b = held + len(left[-1]), b + group
        have = left[0] if len(left) == 1 else np.concatenate(left)
        yield int(doc_id), have[:n]
        left, held = [have[n:]], held - n


def _parts(ids: np.ndarray, rows: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The number of bounds (id, row), which are sorted, that each (id, row) isn't below."""
    first, last = (np.searchsorted(bounds[0], ids, side) for side in ("left", "right"))
    for i in np.nonzero(first < last)[0]:
        first[i] += np.searchsorted(bounds[1][first[i] : last[i]], rows[i], "right")
    return first.astype(np.int32)


def _encoded(batches, path, end_id, bounds):
    """Of each row its part, id, how many ids its text has and those ids, two bytes each where all fit."""
    pack, tail = encoder(path).pack, struct.pack("<I", end_id)
    for b in batches:
        sizes, packed = [], []
        for t in b["text"].to_pylist():
            raw = np.frombuffer(pack(t) + tail, "<u4")
            sizes.append(len(raw))
            packed.append((raw.astype("<u2") if raw.max() < 1 << 16 else raw).tobytes())
        part = _parts(b["id"].fill_null(NULL_ID).to_numpy(), b["row"].to_numpy(), bounds)
        yield pa.RecordBatch.from_arrays([pa.array(part), b["id"], b["row"], pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())], names=["part", "id", "row", "n", "ids"])


def _write(batches, folder):
    """One file for each part of sorted rows: its name, documents and ids. Only packed ids of one part are held, two or four bytes each."""
    schema = pa.schema([("part", pa.int64()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    part, docs, held = None, [], []

    def file():
        ids = np.concatenate(held)
        held.clear()
        write_bytes(uri := f"{folder}/ids-{part:06d}.s8b", file_parts(docs, ids))
        return pa.RecordBatch.from_pydict({"part": [part], "uri": [uri], "n_docs": [len(docs)], "n_ids": [len(ids)]}, schema=schema)

    for b in batches:
        for p, i, n, raw in zip(*(b[c].to_pylist() for c in ("part", "id", "n", "ids")), strict=True):
            if p != part and docs:
                yield file()
                docs = []
            part = p
            docs.append((NULL_ID if i is None else i, n))
            held.append(np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4"))
    if docs:
        yield file()


#: Stands for a null id in files.
NULL_ID = -(1 << 63)


def _read(batches):
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for b in batches:
        for uri, start in zip(b["uri"].to_pylist(), b["start"].to_pylist(), strict=True):
            rows, held = [], 0
            for doc_id, ids in read_ids(uri):
                rows.append((None if doc_id == NULL_ID else doc_id, start, len(ids), ids.astype("<u4").tobytes()))
                start, held = start + len(ids), held + len(ids)
                if held >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _digest(batches):
    for b in batches:
        crc = pa.array([zlib.crc32(x) for x in b["ids"].to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([b["id"], b["start"], b["n_tokens"], crc], names=["id", "start", "n_tokens", "ids_crc32"])


def _bounds(rows: DataFrame, n: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (id, row) that cut the rows into about equal parts, from a sample of them."""
    share = min(SAMPLE_PART * parts, SAMPLE) / max(1, n)
    got = (rows.sample(share, seed=1) if share < 1 else rows).toArrow()
    ids, row = got["id"].fill_null(NULL_ID).to_numpy(), got["row"].to_numpy()
    order = np.lexsort((row, ids))
    cuts = order[np.arange(1, parts) * len(order) // parts] if len(order) else order
    return ids[cuts], row[cuts]


def write_ids(docs: DataFrame, path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of all documents; returns the manifest (part, uri, n_docs, n_ids, start), one row for each file.

    Rows go to ranges of (id, row): rows with the same id, or none, are parted by their place, so that no id is too large
    for a file. Bounds come from a sample of (id, row), at most about SAMPLE rows whatever the input; they decide how even
    files are, nothing else. So a text is encoded once, where it is read, and only its packed ids are shuffled.
    The manifest has a row for a file, not for a document; the prefix sum over it is the only step that meets in one task.
    """
    spark = docs.sparkSession
    prepare(spark)
    folder = folder or shared_dir(spark, "id-files")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("text"))
    n_bytes, n = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    parts = max(1, int(n_bytes or 0) // (ID_BYTES * file_ids), min(int(n), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    encode_rows = partial(_encoded, path=path, end_id=end_id, bounds=_bounds(rows.select("id", "row"), n, parts))
    packed = rows.mapInArrow(encode_rows, "part int, id long, row long, n long, ids binary")
    ranges = packed.repartitionById(parts, "part").sortWithinPartitions("part", "id", "row")
    files = stored(ranges.select("part", "id", "n", "ids").mapInArrow(partial(_write, folder=folder), "part long, uri string, n_docs long, n_ids long"), "id-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_manifest(manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids as little-endian unsigned 32-bit bytes) of every document, from the files."""
    n = max(1, manifest.count())
    return manifest.select("uri", "start").repartition(n, "uri").mapInArrow(_read, "id long, start long, n_tokens long, ids binary")


def digests(documents: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return documents.mapInArrow(_digest, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
