import random
import re
from collections import Counter

from strandloom.llm import decontaminate as M
from strandloom.llm.queries import op9_decontamination


def toks(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def grams(w):
    g = min(5, len(w))
    return Counter(tuple(w[i : i + g]) for i in range(len(w) - g + 1)) if w else Counter()


def brute(docs, items):
    out = set()
    for d, t in docs:
        w = toks(t)
        held = {tuple(w[i : i + g]) for g in range(1, 6) for i in range(len(w) - g + 1)}
        for i, b in items:
            v = toks(b)
            if not v:
                continue
            a, best = grams(v), None
            if held.isdisjoint(a):
                continue
            g = min(5, len(v))
            for s in range(max(0, len(w) - len(v)) + 1 if len(w) >= g else 0):
                x = Counter(tuple(w[k : k + g]) for k in range(s, min(s + len(v), len(w)) - g + 1))
                c = sum((a & x).values())
                sim = c / sum((a | x).values())
                if sim >= 0.8 and (best is None or sim > best[0]):
                    best = (sim, s)
            if best:
                out.add((d, i, best[1], min(len(v), len(w)), round(best[0], 9)))
    return out


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(400)] + ["Été", "Ñu"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(rng.randint(12, 60)))) for k in range(12)] + [(50, "Tiny item"), (51, "tiny, ITEM!"), (52, ""), (53, None), (54, "a a a a a a a a a a a a a"), (None, "an item that has no id but words enough")]
    docs = []
    for d in range(60):
        w = say(rng.randint(0, 120))
        _, t = rng.choice(items)
        v = (t or "").split()
        if v and d % 3:
            if d % 4 == 1:
                v[rng.randrange(len(v))] = "changed"
            if d % 4 == 2:
                v = v[1:]
            at = rng.randint(0, len(w))
            w[at:at] = v
        docs.append((d, ", ".join(w).upper() if d % 5 else " ".join(w)))
    docs += [(70, None), (71, ""), (72, "b a a a a a a a a a a a a a a a c"), (73, "so a tiny item here"), (None, "x an item that has no id but words enough y")]
    frame = spark.createDataFrame([(d, t, 0, 1) for d, t in docs + docs[:5]], "doc_id long, text string, h int, start int")
    bench = spark.createDataFrame([(i, t, 2) for i, t in items], "item_id long, text string, n int")
    got = {(r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 9)) for r in M.find(frame, bench).collect()}
    want = brute(docs, items)
    assert got == want
    kept = M.clean(frame, bench)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {w[0] for w in want}
    before = M.SET, M.BROADCAST
    try:
        for M.SET, M.BROADCAST in ((3, 10_000), (3, 3)):
            assert {(r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 9)) for r in M.find(frame, bench).collect()} == want
    finally:
        M.SET, M.BROADCAST = before


def test_items_cut_off_at_the_ends_of_a_document(spark):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(400)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate([12, 16, 20, 24, 24, 30, 40, 60])]
    docs = []
    for _, t in items:
        v = t.split()
        for cut in (1, 2, 4):
            for more in (0, 1, 7, 50):
                docs += [v[cut:] + say(more), say(more) + v[:-cut]]
        docs.append(v[1:-1])
    docs = [(d, " ".join(w)) for d, w in enumerate(docs)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert len(want) > len(items) * 4 and any(n < len(toks(dict(items)[i])) for _, i, _, n, _ in want)
    assert {(r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 9)) for r in M.find(frame, bench).collect()} == want
    assert {r.doc_id for r in M.clean(frame, bench).collect()} == {d for d, _ in docs} - {w[0] for w in want}


def test_moved_sentences_and_repeats(spark):
    """Windows stand at every place: halves of an item that changed places align with it nowhere."""
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(300)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(k, " ".join(say(n))) for k, n in enumerate([45, 60, 60, 90])] + [(9, "la " * 40 + " ".join(say(20)))]
    docs = []
    for _, t in items:
        v = t.split()
        h = len(v) // 2
        for before, after in ((0, 0), (5, 9), (30, 0), (0, 30)):
            docs.append(say(before) + v[h:] + v[:h] + say(after))
        docs += [["la"] * 90, v + v, say(10) + v[1:] + v[:-1] + say(3)]
    docs = [(d, " ".join(w)) for d, w in enumerate(docs)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert sum(s < 1 for *_, s in want) > 8
    assert {(r.doc_id, r.item_id, r.start, r.n_words, round(r.similarity, 9)) for r in M.find(frame, bench).collect()} == want


def test_recall_of_windows_at_the_similarity(spark):
    """Items with words changed until the similarity is just held: the radius keeps at least nine of ten documents."""
    rng = random.Random(13)
    vocab = [f"w{k}" for k in range(2000)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items, docs = [(k, " ".join(say(rng.randint(30, 80)))) for k in range(60)], []
    for i, t in items:
        for _ in range(8):
            v, a = t.split(), grams(t.split())
            for at in rng.sample(range(len(v)), len(v)):
                changed = [*v[:at], "new", *v[at + 1 :]]
                x = grams(changed)
                if 5 * sum((a & x).values()) < 4 * sum((a | x).values()):
                    break
                v = changed
            docs.append(say(rng.randint(0, 40)) + v + say(rng.randint(0, 40)))
    docs = [(d, " ".join(w)) for d, w in enumerate(docs)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i) for d, i, *_ in brute(docs, items)}
    got = {(r.doc_id, r.item_id) for r in M.find(frame, bench).collect()}
    print("recall at the similarity", len(got), "of", len(want))
    assert got <= want and len(want) >= 480 and len(got) >= 0.95 * len(want)


def test_clean_goes_by_text(spark):
    item = "one two three four five six seven eight nine ten"
    rows = [(None, item), (None, "clean text without an id"), (None, "another clean one"), (4, item), (4, "same id but clean"), (4, item), (5, None), (5, "")]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, key int")
    got = [(r.doc_id, r.text) for r in M.clean(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([r for r in rows if r[1] != item], key=str)


def test_very_long_text_and_item(spark):
    rng = random.Random(17)
    say = lambda n: " ".join(str(rng.randrange(10**6)) for _ in range(n))
    item, long = say(1500), say(300_000)
    docs = spark.createDataFrame([(1, long + " " + item + " " + long), (2, long)], "doc_id long, text string")
    got = M.find(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.start, r.n_words, r.similarity) for r in got] == [(1, 300_000, 1500, 1.0)]


def test_fingerprints_of_more_hashes_than_sixteen_bits_hold(spark):
    rows = spark.range(140_000).selectExpr("0 AS key", "CASE WHEN id < 80000 THEN -1L ELSE 5L END AS h")
    assert M._simhash(rows, ["key"]).first().fp == -1


def test_empty_tables(spark):
    docs, bench = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert M.find(docs.limit(0), bench).collect() == [] == M.find(docs, bench.limit(0)).collect()
    assert M.clean(docs, bench.limit(0)).count() == 1 and M.clean(docs, bench).count() == 0


def test_query_finds_what_contains_an_item(spark):
    d = "/root/testdata/sf0.01"
    got = {(r.doc_id, r.item_id) for r in op9_decontamination(spark, d).collect()}
    docs = [(r.doc_id, " " + " ".join(toks(r.text)) + " ") for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    items = [(r.item_id, " " + " ".join(toks(r.text)) + " ") for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    exact = {(i, b) for i, t in docs for b, x in items if x in t}
    assert exact and exact <= got and len(got) <= len(exact) * 1.2 + 2
