import random
import struct
import zlib
from collections import defaultdict

import pytest

from strandloom.llm import packing as M
from strandloom.llm.queries import vocabulary


@pytest.mark.parametrize("seed", range(6))
def test_groups_are_whole_and_tight(seed):
    rng = random.Random(seed)
    lengths = [min(100, int(rng.paretovariate(0.8) * 5)) for _ in range(rng.randint(0, 900))]
    bins = M.pack_lengths(lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= 1.02 * sum(lengths) / 100 + 2


def used(bins):
    return sum(map(bool, bins))


@pytest.mark.parametrize("seed", range(5))
def test_exchanges_keep_documents_and_empty_bins(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(15, 60) for _ in range(400)]
    bins = M.best_fit(lengths, 100)
    # a poor packing to start from: two documents a bin where two fit
    poor = [[x] for x in lengths[:1]]
    for n in lengths[1:]:
        if len(poor[-1]) == 1 and poor[-1][0] + n <= 100:
            poor[-1] = sorted([*poor[-1], n])
        else:
            poor.append([n])
    least, before = M.lower_bound(lengths, 100), sum(sum(b) ** 2 for b in poor)
    start = used(poor)
    M.improve(poor, 100, least)
    assert sorted(n for b in poor for n in b) == sorted(lengths) and all(sum(b) <= 100 for b in poor)
    assert least <= used(poor) < start and sum(sum(b) ** 2 for b in poor) > before
    assert used(poor) <= 1.1 * used(bins)


def test_each_kind_of_exchange_empties_a_bin_that_best_fit_leaves():
    for bins, capacity in (([[10], [60, 30]], 100), ([[35], [30, 65], [60]], 100), ([[48], [21, 30, 40], [9], [43]], 100), ([[20, 28], [47, 50], [52]], 100)):
        lengths, before = [n for b in bins for n in b], sum(sum(b) ** 2 for b in bins)
        M.improve(bins, capacity, 0)
        assert sorted(n for b in bins for n in b) == sorted(lengths) and sum(sum(b) ** 2 for b in bins) > before
    lengths = [51, 27, 26, 23, 25, 24, 24] * 40
    plain = M.best_fit([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], 60)
    assert used(plain) == 4 and M.lower_bound([44, 24, 24, 22, 21, 17, 8, 8, 6, 6], 60) == 3
    M.improve(plain, 60, 3)
    assert used(plain) == 3 and 80 <= len(M.pack_lengths(lengths, 100)) < used(M.best_fit(lengths, 100))


def least_bins(lengths, capacity):
    """Exact, by trying every bin for every document."""
    best = len(lengths)

    def put(k, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if k == len(lengths):
            best = len(bins)
            return
        for i, n in enumerate(bins):
            if n + lengths[k] <= capacity and n not in bins[:i]:
                put(k + 1, [*bins[:i], n + lengths[k], *bins[i + 1 :]])
        put(k + 1, [*bins, lengths[k]])

    put(0, [])
    return best


def test_bound_and_packing_against_all_packings():
    rng = random.Random(9)
    worse = 0
    for _ in range(150):
        lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
        exact = least_bins(sorted(lengths, reverse=True), 30)
        got = len(M.pack_lengths(lengths, 30))
        assert M.lower_bound(lengths, 30) <= exact <= got <= exact + 1
        worse += got > exact
    assert worse <= 2 and M.lower_bound([], 30) == 0


def test_pieces_equal_the_library(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    texts = ["A  tie\n", "A  tie\n", None, "", "Über " * 3000, "漢字 <|endoftext|> don't", "x" * 9000, *(f"word {i} " * (i % 50) for i in range(300))]
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    plan = M.pack(docs, vocabulary("word_bpe_49k.json"), end_id=1, capacity=512)
    got, by_doc, by_seq = plan.collect(), defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}
    for i, rows in by_doc.items():
        rows.sort(key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in rows] == [(k, at, min(512, len(ids[i]) - at)) for k, at in enumerate(range(0, len(ids[i]), 512))]
        assert all(r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[i][r.start : r.start + r.length])) for r in rows)
    assert by_doc.keys() == ids.keys()
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512
    seqs = {r.sequence_id: r for r in M.sequences(docs, plan, vocabulary("word_bpe_49k.json"), 1, 512).collect()}
    for r in got:
        assert seqs[r.sequence_id].ids[4 * r.offset : 4 * (r.offset + r.length)] == struct.pack(f"<{r.length}I", *ids[r.doc_id][r.start : r.start + r.length])


def test_groups_null_and_repeated_ids(spark):
    """Many groups: every piece once, sequences whole, and the same plan at each reading."""
    rows = [(None if k % 5 == 0 else k % 40, "word " * (k % 97)) for k in range(700)]
    plan = M.pack(spark.createDataFrame(rows, "doc_id long, text string"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=128, group=50)
    got = plan.collect()
    assert sorted(got, key=str) == sorted(plan.collect(), key=str) and len({r.sequence_id >> 32 for r in got}) >= 10
    assert sorted((r.doc_id or -1, r.length) for r in got) == sorted((-1 if i is None else i or -1, t.count("w") + 1) for i, t in rows)
    by_seq = defaultdict(list)
    for r in got:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for parts in by_seq.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 128


def test_empty_table(spark):
    assert M.pack(spark.createDataFrame([], "doc_id long, text string"), vocabulary("word_bpe_49k.json"), 1).collect() == []
