import struct
import zlib

import numpy as np
import pytest

from strandloom.llm import id_files as M
from strandloom.llm.queries import vocabulary


@pytest.mark.parametrize("n", [0, 1, 59, 60, 61, 1023, 1024, 1025, 50_000])
def test_words_round_trip(n):
    rng = np.random.default_rng(n)
    ids = (rng.integers(0, 1 << 40, n) >> rng.integers(0, 41, n)).astype(np.uint64)
    if n > 60:
        ids[:60], ids[60] = 1, (1 << 60) - 1
    for x in (ids, ids.astype(np.uint16)):
        words, sizes = M.encode(x)
        assert sizes.sum() == len(words) and (M.decode(words) == x).all()


def test_parts_follow_id_and_row():
    bounds = (np.array([1, 5, 5, 5, 9]), np.array([4, 2, 6, 6, 0]))
    ids, rows = np.array([M.NULL_ID, 1, 1, 5, 5, 5, 7, 9, 10]), np.array([9, 3, 4, 1, 2, 6, 0, 0, 0])
    want = [sum((b, r) <= (i, k) for b, r in zip(*bounds, strict=True)) for i, k in zip(ids, rows, strict=True)]
    assert M._parts(ids, rows, bounds).tolist() == want


def test_any_sample_gives_the_same_rows(spark, monkeypatch):
    docs = spark.createDataFrame([(k % 50, "a " * (k % 7)) for k in range(400)], "doc_id long, text string").repartition(3).sortWithinPartitions("doc_id", "text")
    rows = lambda: sorted((r.id, r.n_tokens) for r in M.read_manifest(M.write_ids(docs, vocabulary("byte_bpe_50k.json"), 2, file_ids=20)).collect())
    whole = rows()
    for few in (0, 3, 40):
        monkeypatch.setattr(M, "SAMPLE", few)
        assert rows() == whole and len(whole) == 400


def test_files_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    texts = ["b  c\n", None, "", "x" * 3000, "tie", "word " * 4000, "é<|endoftext|>é"]
    rows = [(7 - i, t, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start long")
    manifest = M.write_ids(docs, vocabulary("byte_bpe_50k.json"), end_id=2)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in M.digests(M.read_manifest(manifest)).collect()}
    want, start = {}, 0
    for i, t, _ in sorted(rows):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        start += len(ids)
    assert got == want


def test_empty_table_and_null_id(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert M.read_manifest(M.write_ids(docs, vocabulary("byte_bpe_50k.json"), 2)).collect() == []
    docs = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    got = M.read_manifest(M.write_ids(docs, vocabulary("byte_bpe_50k.json"), 2)).collect()
    assert sorted((-1 if r.id is None else r.id, r.start) for r in got) == [(-1, 0), (1, 2), (1, 4)]


def test_one_id_or_none_for_all_rows(spark):
    """Rows with equal or null ids fill several files, in the order of the rows."""
    docs = spark.createDataFrame([(None if k % 2 else 5, f"word{k} " * (k % 9)) for k in range(900)], "doc_id long, text string").repartition(6)
    manifest = M.write_ids(docs, vocabulary("byte_bpe_50k.json"), 2, file_ids=400)
    files = manifest.collect()
    got = M.read_manifest(manifest).collect()
    assert len(files) > 8 and max(f.n_ids for f in files) < 3 * sum(f.n_ids for f in files) / len(files)
    rows = sorted(got, key=lambda r: r.start)
    assert len(rows) == 900 and [r.id for r in rows] == [None] * 450 + [5] * 450
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(900)]


def test_ids_equal_the_library_on_whole_documents(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r.id: bytes(r.ids) for r in M.read_manifest(M.write_ids(spark.createDataFrame(rows), vocabulary("byte_bpe_50k.json"), 2)).collect()}
    for r, enc in zip(rows, tok.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True):
        assert got[r.doc_id] == struct.pack(f"<{len(enc.ids) + 1}I", *enc.ids, 2)
