import random

import pytest
from pyspark.sql import types as T

from strandloom.llm.queries import vocabulary
from strandloom.llm.token_counts import count_tokens
from strandloom.llm.tokens import Encoder


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    return lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)


def texts():
    rng = random.Random(5)
    bits = ["a", "the", " ", "  ", "\n", "\t", "é", "'re", "'", "12", "!?", "<|endoftext|>", "<|endof", "漢字", " ", "\x1c", "ß", "é"]
    out = ["", None, " ", "\n\n", "x" * 5000, " " * 5000, "ab " * 3000, "é" * 4000 + " z"]
    return out + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 4000))) for _ in range(40)]


def test_counts_equal_the_library_with_tiny_chunks(spark, plain):
    rows = [(i, t, i, "x") for i, t in enumerate(texts())] + [(3, "twice the same id", 0, "x"), (None, "no id", 0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long, row string")
    got = count_tokens(docs, vocabulary("byte_bpe_50k.json"), huge=300, chunk=200, overlap=40).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((i or -1, len((t or "").encode()), plain(t), plain(t) > 512) for i, t, *_ in rows)


def test_empty_table(spark):
    assert count_tokens(spark.createDataFrame([], "doc_id long, text string"), vocabulary("byte_bpe_50k.json")).collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_equal_the_library(name):
    import numpy as np

    e = Encoder(vocabulary(name))
    for t in texts():
        assert np.frombuffer(e.pack(t or ""), "<u4").tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids
