"""WARC archives with a two-level capture index.

Archives: one gzip member per record. Pages of equal payload share one response record, that of the smallest page id;
the others are revisit records that keep the HTTP header, the payload's digest and the response's record id.

Index: lines "key, page id, archive, offset, length", sorted by reversed-host URL key, in compressed blocks; a sparse
directory holds the first key and the place of each block. A lookup has three steps, each spread over tasks: keys are
binary-searched in the directory, which gives the block (or the run of blocks that a key spans); each block is read once
by range and its keys are binary-searched in its lines; captures are read by range, archive by archive. A key that holds
a third of all captures so becomes many blocks, which go to many tasks. Every step reads what it needs and no more.

A worker holds the directory: a key and a place for LINES captures.

Payloads cross one shuffle, the join with the table of repeated digests, which Spark splits where a payload is hot; that
table has no payloads. Rows of an archive are sorted, so a task that runs again writes the same bytes.

Defined results: a null html is an empty payload, grouped like any other; a null url has an empty key; a null page id is
a revisit where an equal payload has an id, else a response; rows that repeat a response's page id are responses too; an
empty table gives no archives and no rows; other columns, whatever their names, are not read. A URL reads back as it was,
whatever its characters (those of a URI stay, others and the percent sign are percent-coded); a null one as empty.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from functools import lru_cache, partial
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import file_system, prepare, read_range, shared_dir, stored, text_or_empty, write_bytes

#: Lines of an index block; records of one archive go to a task in spans of two to the power of SPAN bytes.
LINES, SPAN = 2000, 25
DATE = "1970-01-01T00:00:00Z"
HOST = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)(?::[0-9]*)?([^#]*)")


def url_key(url: str | None) -> str:
    """com,example,www)/path?query: host labels reversed and in lower case, without scheme, port and fragment."""
    if not (m := HOST.match(url or "")):
        return quote((url or "").partition("#")[0], safe="/?&=:;,.~!$'()*+@%-_")
    return ",".join(reversed(m[1].lower().split("."))) + ")" + quote(m[2] or "/", safe="/?&=:;,.~!$'()*+@%-_")


def _label(digest_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe="/?&=:;,.~!$'()*+@-_#[]")}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n") + pack.flush()


def parse(raw: bytes) -> dict:
    """A record's fields; the payload of a response is checked against its digest."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, revisit = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
    number = lambda x: int(i) if (i := x[len("<urn:x-page:") : -1]) else None
    return {"page_id": number(fields["WARC-Record-ID"]), "url": unquote(fields["WARC-Target-URI"]), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload}


def _write(batches, folder):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    uri, at, out = f"{folder}/archives/part-{part:06d}.warc.gz", 0, {"key": [], "page_id": [], "uri": [], "offset": [], "length": []}

    def records():
        nonlocal at
        for b in batches:
            for i, url, payload, digest, first in zip(*(b[c].to_pylist() for c in ("page_id", "url", "payload", "digest", "first")), strict=True):
                raw = record(i, url, payload, _label(digest), first, first is not None and first != i)
                for name, value in (("key", url_key(url)), ("page_id", i), ("uri", uri), ("offset", at), ("length", len(raw))):
                    out[name].append(value)
                at += len(raw)
                yield raw

    stream = records()
    if (head := next(stream, None)) is not None:
        write_bytes(uri, _chain(head, stream))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))


def _chain(head, rest):
    yield head
    yield from rest


def _index(batches, folder, lines):
    """Sorted lines in compressed blocks, and a directory row for each."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    uri, at, held = f"{folder}/index/part-{part:06d}.cdx.z", 0, []
    rows = {"part": [], "block": [], "first_key": [], "index_uri": [], "offset": [], "length": [], "n": []}

    def block():
        nonlocal at
        raw = zlib.compress("\n".join("\t".join(map(str, x)) for x in held).encode(), 6)
        for name, value in (("part", part), ("block", len(rows["n"])), ("first_key", held[0][0]), ("index_uri", uri), ("offset", at), ("length", len(raw)), ("n", len(held))):
            rows[name].append(value)
        at += len(raw)
        held.clear()
        return raw

    def blocks():
        for b in batches:
            for row in zip(*(b[c].to_pylist() for c in ("key", "page_id", "uri", "offset", "length")), strict=True):
                held.append(["" if x is None else x for x in row])
                if len(held) == lines:
                    yield block()
        if held:
            yield block()

    stream = blocks()
    if (head := next(stream, None)) is not None:
        write_bytes(uri, _chain(head, stream))
        yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_key", pa.string()), ("index_uri", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("n", pa.int64())]))


def lines_of(uri: str, offset: int, length: int) -> list[list[str]]:
    return [x.split("\t") for x in zlib.decompress(read_range(uri, offset, length)).decode().split("\n")]


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, lines: int = LINES) -> str:
    """Writes archives, index blocks and directory; returns their folder. Payloads under `least` bytes are never revisits."""
    spark = pages.sparkSession
    prepare(spark)
    folder = folder or shared_dir(spark, "warc")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(text_or_empty("html"), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    repeated = stored(rows.where(F.length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "warc-repeated")
    placed = rows.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", F.when(F.length("payload") >= least, F.col("first")).alias("first"))
    captures = stored(placed.sortWithinPartitions("page_id", "url").mapInArrow(partial(_write, folder=folder), "key string, page_id long, uri string, offset long, length long"), "warc-captures")
    n = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // (8 * lines))))
    blocks = captures.repartitionByRange(n, "key", "page_id").sortWithinPartitions("key", "page_id", "uri", "offset").mapInArrow(partial(_index, folder=folder, lines=lines), "part int, block int, first_key string, index_uri string, offset long, length long, n long")
    blocks.write.parquet(f"{folder}/directory")
    return folder


def directory(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("part int, block int, first_key string, index_uri string, offset long, length long, n long").parquet(f"{folder}/directory")


RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _records(batches, payloads):
    name, file = None, None
    for b in batches:
        out = []
        for uri, at, n in zip(*(b[c].to_pylist() for c in ("uri", "offset", "length")), strict=True):
            if uri != name:
                store, path = file_system(uri)
                name, file = uri, store.open_input_file(path)
            file.seek(at)
            out.append(parse(file.read(n)) | ({} if payloads else {"payload": None}))
        yield pa.RecordBatch.from_pylist(out, schema=RECORD_SCHEMA)


@lru_cache(maxsize=2)
def _directory(uri: str) -> tuple[list[bytes], list[tuple]]:
    """The sparse directory, in the order of the sorted index."""
    import pyarrow.dataset as ds

    store, path = file_system(uri)
    rows = sorted(ds.dataset(path, filesystem=store, format="parquet").to_table().to_pylist(), key=lambda r: (r["part"], r["block"]))
    return [r["first_key"].encode() for r in rows], [(r["index_uri"], r["offset"], r["length"]) for r in rows]


def _blocks_of(batches, folder):
    """(key, block) of every block that may hold a key, by binary search in the directory."""
    firsts, places = _directory(f"{folder}/directory")
    for b in batches:
        out = []
        for key in b["key"].to_pylist():
            raw = key.encode()
            out += [(key, *places[k]) for k in range(max(0, bisect_left(firsts, raw) - 1), bisect_right(firsts, raw))]
        if out:
            key, uri, at, n = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(uri, pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["key", "index_uri", "offset", "length"])


def _captures(batches):
    """(archive, offset, length) of the keys' lines, by binary search in each block; rows come block by block."""
    place, lines, keys = None, [], []
    for b in batches:
        out = []
        for key, *here in zip(*(b[c].to_pylist() for c in ("key", "index_uri", "offset", "length")), strict=True):
            if here != place:
                place, lines = here, lines_of(*here)
                keys = [x[0].encode() for x in lines]
            raw = key.encode()
            out += [(x[2], int(x[3]), int(x[4])) for x in lines[bisect_left(keys, raw) : bisect_right(keys, raw)]]
        if out:
            uri, at, n = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(uri, pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["uri", "offset", "length"])


def _keys(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([url_key(x) for x in b["url"].to_pylist()], pa.string())], names=["key"])


def lookup(urls: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of all captures whose key is that of a given URL, each once."""
    spark = urls.sparkSession
    prepare(spark)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = urls.select(F.col("url").cast("string").alias("url")).mapInArrow(_keys, "key string").distinct()
    blocks = keys.mapInArrow(partial(_blocks_of, folder=folder), "key string, index_uri string, offset long, length long")
    found = blocks.repartition(width, "index_uri", "offset").sortWithinPartitions("index_uri", "offset", "key").mapInArrow(_captures, "uri string, offset long, length long")
    return found.repartition(width, "uri", F.shiftright("offset", SPAN)).sortWithinPartitions("uri", "offset").mapInArrow(partial(_records, payloads=payloads), RECORD)
