import base64

import numpy as np
from pyspark.sql import functions as F

from strandloom.llm import langid as M
from strandloom.llm.queries import op2_language_id, vocabulary

PATH = vocabulary("byte_bpe_multi_50k.tiktoken")


def vocabulary_pieces():
    with open(PATH, "rb") as f:
        return {p: k for k, p in enumerate(sorted({base64.b64decode(line.split()[0]) for line in f} - {b""}), 1)}


def ways(word, numbers):
    """Every segmentation of a word, as lists of pieces."""
    raw, out = b" " + word.encode(), []

    def walk(at, path):
        if at == len(raw):
            out.append(path)
        for k in range(1, len(raw) - at + 1):
            if (p := numbers.get(raw[at : at + k])):
                walk(at + k, [*path, p])

    walk(0, [])
    return out


WORDS = ["a", "the", "straße", "été", "xqzjw", "there", "語言模", "don't"]


def test_forward_sums_all_segmentations():
    pieces, numbers = M.pieces_of(PATH), vocabulary_pieces()
    prob = np.random.default_rng(0).random((pieces.size, 3)) / pieces.size
    prob[0] = 0
    want = [np.log(sum(prob[w].prod(axis=0) for w in ways(word, numbers))) for word in WORDS]
    assert np.allclose(M.word_scores(pieces, WORDS, prob), want)


def dynamic(raw, numbers, prob):
    """Plain forward pass in logs, for words of any length."""
    most = max(map(len, numbers))
    logs = [np.zeros(prob.shape[1])] + [None] * len(raw)
    for end in range(1, len(raw) + 1):
        parts = [logs[at] + np.log(prob[p]) for at in range(max(0, end - most), end) if logs[at] is not None and (p := numbers.get(raw[at:end]))]
        logs[end] = np.logaddexp.reduce(parts) if parts else None
    return logs[-1]


def test_words_of_any_length_are_whole():
    """No cut falls into a long word: pieces longer than twelve bytes, and those over byte 240, count like others."""
    pieces, numbers = M.pieces_of(PATH), vocabulary_pieces()
    prob = np.random.default_rng(1).random((pieces.size, 2)) / pieces.size
    prob[0] = 0
    long = max((p for p in numbers if p.isascii()), key=len)
    words = ["ab" * 5000, "日本語の文章には空白がありません" * 20, "x" * 237 + "communication" * 3, long.decode() * 3, "é" * 33, "z" * 31, "z" * 32, *("internationalization" * n for n in (1, 2, 3, 17))]
    words = [w for w in words if not any(c.isspace() for c in w)]
    assert pieces.size == len(numbers) + 1 and max(pieces.lengths) > 12
    got = M.word_scores(pieces, words, prob)
    assert np.allclose(got, [dynamic(b" " + w.encode(), numbers, prob) for w in words])
    assert np.allclose(M.word_scores(pieces, [words[0]] * 2, prob), got[0])


def test_expected_counts_equal_brute_force():
    pieces, numbers = M.pieces_of(PATH), vocabulary_pieces()
    counts = np.random.default_rng(2).integers(0, 4, (len(WORDS), 2)).astype(float)
    want = np.zeros((pieces.size, 2))
    for word, n in zip(WORDS, counts, strict=True):
        all_ways = ways(word, numbers)
        share = np.array([float(pieces.size) ** -len(w) for w in all_ways])
        for w, x in zip(all_ways, share / share.sum(), strict=True):
            for p in w:
                want[p] += x * n
    assert np.allclose(M.expected_counts(pieces, WORDS, counts), want)


def test_languages_without_blanks_learn():
    pieces, numbers = M.pieces_of(PATH), vocabulary_pieces()
    word = "機器學習模型需要大量的訓練資料才能運作"
    got = M.expected_counts(pieces, [word, word * 40], np.array([[1.0], [1.0]]))[:, 0]
    size = {k: len(p) for p, k in numbers.items()}
    assert np.isclose(sum(n * size.get(k, 0) for k, n in enumerate(got)), 2 + 41 * len(word.encode()))


def test_held_out_accuracy(spark):
    got = op2_language_id(spark, "/root/testdata/sf0.01").alias("p").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count(F.lit(1)), F.sum((F.col("lang_pred") == F.col("lang")).cast("int"))).first()
    print(n, right)
    assert n > 150 and right / n > 0.97


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", 1), (3, "le chat et le chien", "fr", 1), (2, None, "en", 1), (4, "", None, 1), (5, "12 !?", "en", 1), (None, "the dog", None, 1), (1, "the cat and the dog", "en", 1)], "doc_id long, text string, lang string, score int")
    model = M.fit(docs, F.lit(True), PATH)
    got = sorted(((r.doc_id or 0), r.lang_pred, r.score > 0) for r in M.predict(docs, model, PATH).collect())
    assert got == [(0, "en", True), (1, "en", True), (1, "en", True), (2, "und", False), (3, "fr", True), (4, "und", False), (5, "und", False)]
    empty = docs.limit(0)
    assert M.predict(empty, M.fit(empty, F.lit(True), PATH), PATH).collect() == []
    assert {r.lang_pred for r in M.predict(docs, M.fit(empty, F.lit(True), PATH), PATH).collect()} == {"und"}


def test_identified_rows(spark):
    docs = spark.createDataFrame([(1, "the cat and the dog", "en", 1), (3, "le chat et le chien", "fr", 1), (2, None, "en", 1), (4, "", None, 1), (5, "12 !?", "en", 1), (None, "the dog", None, 1), (6, "dog " * 30_000, None, 2)], "doc_id long, text string, lang string, score int")
    model = M.fit(docs, F.lit(True), PATH)
    kept = M.identified(docs, model, PATH)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id or 0), r.lang) for r in kept.collect()) == [(0, "en"), (1, "en"), (3, "fr"), (6, "en")]
    assert M.identified(docs, model, PATH, least=1.1).count() == 0
    assert M.identified(docs.limit(0), model, PATH).collect() == []
    nothing = M.fit(docs.limit(0), F.lit(True), PATH)  # no row with a language: a letter is enough
    assert sorted((r.doc_id or 0) for r in M.identified(docs, nothing, PATH).collect()) == [0, 1, 3, 6]


def test_many_languages(spark):
    docs = spark.createDataFrame([(k, f"word{k} only{k} here{k}", f"l{k:04d}", 1) for k in range(700)], "doc_id long, text string, lang string, score int")
    model = M.fit(docs, F.lit(True), PATH)
    got = {r.doc_id: r.lang_pred for r in M.predict(docs.where("doc_id % 100 = 7"), model, PATH).collect()}
    assert len(model[0]) == 700 and got.keys() == {7, 107, 207, 307, 407, 507, 607} and sum(x == f"l{k:04d}" for k, x in got.items()) >= 6
