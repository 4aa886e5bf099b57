import random
import re

import numpy as np
import xxhash

from strandloom.llm import simhash as M


def brute_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < n else [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    comp = {i: i for i in fps}
    ids, changed = sorted(fps), True
    near = [(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 3]
    while changed:
        changed = False
        for a, b in near:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    return {i: (fps[i], comp[i]) for i in ids}


def sample(seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "Ünd", "A-Z"]
    texts = ["", None, " \n", "One", "one two", "ONE two", "one\x0btwo three", "a\x85b c d"]
    for _ in range(25):
        base = [rng.choice(vocab) for _ in range(rng.randint(30, 300))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_components_equal_brute_force(spark):
    rows = sample()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fp int, key string")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in M.near_duplicates(docs).collect()}
    assert got == brute_components(rows)


def test_tiles_find_every_link(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 3).astype(np.uint64)
    fps = {int(b) for b in base}
    for _ in range(400):
        x = list(fps)[rng.integers(len(fps))]
        for b in rng.integers(0, 64, rng.integers(1, 5)):
            x ^= 1 << int(b)
        fps.add(x)
    fps = sorted(fps)
    data = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x, i) for i, x in enumerate(fps)], "fp long, rep long")
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in M.links(data, 3, tile=16).collect():
        assert (fps[r.u] ^ fps[r.v]).bit_count() <= 64
        root[max(find(r.u), find(r.v))] = min(find(r.u), find(r.v))
    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= 3:
                assert find(a) == find(b)


def test_repeated_rows_null_ids_and_empty_table(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (None, "alone here it is")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in M.near_duplicates(docs).collect()) == [(0, 0), (0, 4), (4, 4), (4, 4)]
    assert M.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_ids_of_any_size_name_components(spark):
    top = (1 << 62) + 5
    rows = [(top, "a b c d"), (top + 2, "a b c d"), (-(1 << 63), "lone words are here"), (None, "no id at all"), (None, "no id at all"), ((1 << 63) - 1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in M.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(top, top), (top + 2, top), (-(1 << 63), -(1 << 63)), (None, None), (None, None), ((1 << 63) - 1, (1 << 63) - 1)], key=str)


def test_very_long_text(spark):
    rng = random.Random(2)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(400_000))
    docs = spark.createDataFrame([(1, text), (2, text + " end"), (3, "short")], "doc_id long, text string")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in M.near_duplicates(docs).collect()}
    assert got == brute_components([(1, text), (2, text + " end"), (3, "short")]) and got[2][1] == 1
