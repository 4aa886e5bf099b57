import random
from itertools import combinations

import pytest

from strandloom.llm import similar as M
from strandloom.llm.common import clear, numbered, picked, stored
from strandloom.llm.simhash import deduplicated

SF = "/root/testdata/sf0.001"


def grams(text):
    w = (text or "").encode().lower().split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()


def brute_links(rows):
    sets = {i: grams(t) for i, t in rows}
    return {(a, b) for a, b in combinations(sorted(sets), 2) if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def sample(seed=5):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["É", "Ünd"]
    line, texts = " ".join(rng.choice(vocab) for _ in range(30)), ["", None, " \n", "One", "one", "one two", "a b c d e", "A B c d e f"]
    for _ in range(30):
        base = [rng.choice(vocab) for _ in range(rng.randint(20, 200))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            texts.append(" ".join(copy[rng.randint(0, 3) :]) + (" " + line if rng.random() < 0.5 else ""))
    rng.shuffle(texts)
    return list(enumerate(texts))


def brute_groups(rows):
    """The smallest row in reach of each."""
    root, links = {i: i for i, _ in rows}, brute_links(rows)
    while changed := {(a, b) for a, b in links if root[a] != root[b]}:
        for a, b in changed:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_groups_equal_brute_force(spark):
    rows = sample()
    frame = stored(spark.createDataFrame(rows, "row long, text string"), "t")
    want = brute_groups(rows)
    assert len(set(want.values())) < len(rows) - 15
    assert {r.row: r.root for r in M.groups(frame).collect()} == want
    before, M.SAMPLE, M.OFTEN = (M.SAMPLE, M.OFTEN), 1, 2
    try:
        assert {r.row: r.root for r in M.groups(frame).collect()} == want
    finally:
        M.SAMPLE, M.OFTEN = before


def test_chains_need_more_than_the_smallest_row_of_a_cell(spark):
    """Each text is similar to the next only; shuffled numbers keep the chain from being a star."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[k : k + 100]) for k in range(0, 300, 6)] + [" ".join(rng.sample(words, 100)) for _ in range(20)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = list(zip(order, texts, strict=True))
    assert {r.row: r.root for r in M.groups(stored(spark.createDataFrame(rows, "row long, text string"), "t")).collect()} == brute_groups(rows)


def test_meetings_of_a_large_group_grow_with_its_rows(spark, monkeypatch):
    """Near copies about the similarity, so that neither one row nor a few drawn ones are linked to all: no join sends on their pairs."""
    rng, candidates, met = random.Random(3), M._candidates, []
    monkeypatch.setattr(M, "_candidates", lambda meetings: met.append(meetings.count()) or candidates(meetings))
    base, texts = [f"w{k}" for k in range(120)], []
    for k in range(400):
        copy = list(base)
        for n in range(rng.randint(1, 3)):
            copy[rng.randrange(120)] = f"x{k}_{n}"
        texts.append(" ".join(copy))
    rows = list(enumerate(texts))
    want = brute_groups(rows)
    assert 20 < len(set(want.values())) < 300
    assert {r.row: r.root for r in M.groups(stored(spark.createDataFrame(rows, "row long, text string"), "t")).collect()} == want
    assert sum(met) < 64 * len(rows)


def test_all_cells_compared_in_tiles(spark, monkeypatch):
    """Cells with much and with little in common, one tile and many."""
    for name, value in (("LARGE", 1), ("STRAYS", 0), ("TILE", 2), ("TILES", 3), ("TILE_SHINGLES", 400)):
        monkeypatch.setattr(M, name, value)
    rows = sample(8)
    assert {r.row: r.root for r in M.groups(stored(spark.createDataFrame(rows, "row long, text string"), "t")).collect()} == brute_groups(rows)


@pytest.mark.parametrize("keep", [True, False])
def test_picked_rows(spark, keep):
    docs, number = numbered(spark.range(1000).selectExpr("id", "concat('t', id) AS Row_Number_Of_Copy").repartition(7), "t")
    assert number == "row_number_of_copy_"
    some = docs.where("id % 3 = 0 AND id > 500").select(number)
    want = {i for i in range(1000) if (i % 3 == 0 and i > 500) == keep}
    assert {r.id for r in picked(docs, number, some, keep).collect()} == want
    assert picked(docs, number, some.limit(0), keep).count() == (0 if keep else 1000)


def test_null_and_repeated_ids(spark):
    near = "a b c d e f g h i j k l m n o p q r s t u v w x y z"
    rows = [(None, near), (7, near), (7, near), (3, "other words that stand alone"), (None, "a text without copies"), (None, None), (None, ""), (9, near + " end")]
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, row int, key string")
    kept = deduplicated(docs)
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()), key=str)
    assert got == sorted([(7, near), (3, "other words that stand alone"), (0, "a text without copies"), (0, "")], key=str)
    assert deduplicated(docs.limit(0)).collect() == []


def test_one_of_each_group_stays(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = {r.doc_id for r in deduplicated(docs).collect()}
    root = brute_groups(rows)
    first = {}
    for i, t in rows:
        first.setdefault(t or "", i)
    assert kept == {i for i, t in rows if root[i] == i and first[t or ""] == i}
    assert clear(spark) > 0
