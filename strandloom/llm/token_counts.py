"""Token counts of whole texts; huge documents are encoded in overlapping chunks that are spliced where both chunks agree.

A vocabulary's pre-tokenizer scans from left to right and keeps no memory from one piece to the next: from a place where
a piece starts, the rest of the scan depends on the text after it alone. So if two overlapping windows both start a
piece at the same place, all later pieces of the right window are those of the whole text. That place is a proven seam.
A chunk without such a place in its overlap is encoded again with its document's overlaps doubled, in the end as a whole.

Defined results: a null text is an empty one (0 bytes, 0 tokens); a null id is kept as it is; repeated ids give a row
each; an empty table gives an empty one; other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import prepare, stored, text_or_empty
from strandloom.llm.tokens import encoder

#: Characters from which a document is cut into chunks, characters of a chunk, and of the first overlap.
HUGE, CHUNK, OVERLAP = 16_000, 12_000, 600
#: Places so near a window's end that text beyond it could still change them: longer than any special token's string.
MARGIN = 32


def _count(batches, path):
    pack = encoder(path).pack
    for b in batches:
        yield pa.RecordBatch.from_arrays([b["id"], b["n_bytes"], pa.array([len(pack(t)) // 4 for t in b["text"].to_pylist()], pa.int64())], names=["id", "n_bytes", "n_tokens"])


def _windows(batches, chunk):
    """A row for each chunk: its text with the overlap that follows it, and where it starts."""
    for b in batches:
        for row, n_bytes, overlap, text in zip(*(b[c].to_pylist() for c in ("row", "n_bytes", "overlap", "text")), strict=True):
            starts = [0] if 2 * overlap >= len(text) else list(range(0, max(1, len(text) - overlap), max(chunk, 2 * overlap)))
            for k, s in enumerate(starts):
                last = k + 1 == len(starts)
                part = text[s:] if last else text[s : starts[k + 1] + overlap]
                yield pa.RecordBatch.from_pydict({"row": [row], "n_bytes": [n_bytes], "overlap": [overlap], "k": [k], "n_chunks": [len(starts)], "start": [s], "seam": [-1 if last else starts[k + 1]], "part": [part]}, schema=pa.schema([("row", pa.int64()), ("n_bytes", pa.int64()), ("overlap", pa.int64()), ("k", pa.int64()), ("n_chunks", pa.int64()), ("start", pa.int64()), ("seam", pa.int64()), ("part", pa.string())]))


def _ends(batches, path):
    """Of each chunk: its tokens, and the places where pieces start in both overlaps with the tokens before them."""
    tok = encoder(path).tokenizer
    for b in batches:
        out = {"row": [], "n_bytes": [], "overlap": [], "k": [], "n_chunks": [], "total": [], "left": [], "right": []}
        for row, n_bytes, overlap, k, n_chunks, start, seam, part in zip(*(b[c].to_pylist() for c in ("row", "n_bytes", "overlap", "k", "n_chunks", "start", "seam", "part")), strict=True):
            enc = tok.encode(part, add_special_tokens=False)
            words, offsets, stop = enc.word_ids, enc.offsets, len(part) - MARGIN
            places = [(start + offsets[i][0], i) for i in range(1, len(words)) if words[i] != words[i - 1] and offsets[i][0] < stop]
            for name, value in (("row", row), ("n_bytes", n_bytes), ("overlap", overlap), ("k", k), ("n_chunks", n_chunks), ("total", len(words))):
                out[name].append(value)
            out["left"].append([{"at": p, "n": n} for p, n in places if k and p < start + overlap])
            out["right"].append([{"at": p, "n": n} for p, n in places if seam >= 0 and seam <= p < seam + overlap])
        place = pa.list_(pa.struct([("at", pa.int64()), ("n", pa.int64())]))
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, place if c in ("left", "right") else pa.int64()) for c in out]))


def _huge(docs: DataFrame, path: str, chunk: int, overlap: int) -> DataFrame:
    """(row, n_tokens) of documents (row, n_bytes, text)."""
    done, todo = None, docs.withColumn("overlap", F.lit(overlap).cast("long"))
    while True:
        windows = todo.select("row", "n_bytes", "overlap", "text").mapInArrow(partial(_windows, chunk=chunk), "row long, n_bytes long, overlap long, k long, n_chunks long, start long, seam long, part string")
        width = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        ends = stored(windows.repartition(width, "row", "k").mapInArrow(partial(_ends, path=path), "row long, n_bytes long, overlap long, k long, n_chunks long, total long, left array<struct<at:long,n:long>>, right array<struct<at:long,n:long>>"), "token-chunks")
        right = ends.select("row", "k", F.inline("right")).withColumnRenamed("n", "n_right")
        left = ends.select("row", (F.col("k") - 1).alias("k"), F.inline("left")).withColumnRenamed("n", "n_left")
        seams = right.join(left, ["row", "k", "at"]).groupBy("row", "k").agg(F.min_by(F.col("n_right") - F.col("n_left"), "at").alias("gain"))
        whole = ends.groupBy("row").agg(F.max("n_chunks").alias("n_chunks"), F.sum(F.when(F.col("k") == F.col("n_chunks") - 1, F.col("total"))).alias("last"))
        spliced = stored(whole.join(seams.groupBy("row").agg(F.count(F.lit(1)).alias("n_seams"), F.sum("gain").alias("gain")), "row", "left").select("row", "last", "n_chunks", F.coalesce("n_seams", F.lit(0)).alias("n_seams"), F.coalesce("gain", F.lit(0)).alias("gain")), "token-seams")
        good = spliced.where("n_seams = n_chunks - 1").select("row", (F.col("last") + F.col("gain")).alias("n_tokens"))
        done = good if done is None else done.unionByName(good)
        failed = spliced.where("n_seams < n_chunks - 1").select("row")
        if failed.isEmpty():
            return done
        todo = todo.join(failed, "row", "left_semi").withColumn("overlap", F.col("overlap") * 2)


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every row; path: a .json file of the tokenizers library."""
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    rows = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), "text")
    kind = dict(rows.dtypes)["id"]
    result = rows.where(F.length("text") <= huge).mapInArrow(partial(_count, path=path), f"id {kind}, n_bytes long, n_tokens long")
    large = stored(rows.where(F.length("text") > huge).withColumn("row", F.monotonically_increasing_id()), "token-huge")
    if not large.isEmpty():
        counted = _huge(large.select("row", "n_bytes", "text"), path, chunk, overlap)
        result = result.unionByName(large.select("row", "id", "n_bytes").join(counted, "row").select("id", "n_bytes", "n_tokens"))
    return result.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
