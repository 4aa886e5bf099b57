"""Language identification by unigram piece models that sum over all segmentations.

Pieces are those of a fixed public vocabulary. A language has a probability for each piece; a word's probability is the
sum, over all ways to cut it into pieces, of the product of their probabilities, which a forward pass adds up; a text's
is the product over its words (pieces never cross white space). The language with the largest probability wins, and the
score is its share among all learned languages.

Fitting: expected piece counts of each language under the equal-probability model (forward and backward pass over each
distinct word), normalised with a small addend. The fit takes about TRAIN_DOCS labelled rows, drawn by a hash of id
and text so that every row is as likely; prediction reads every row whole. Pieces and words of any length take part in
both, so that languages without blanks, whose words are whole sentences, are learned like others. A word's cost grows
with its length, its memory with one place of it (a fit's with all).

The model is a file of the shared folder, vocabulary x languages x 4 bytes, that a worker loads whole.

Defined results: text that is null or without a letter gets "und" and score 0, as does every row when nothing could be
learned; ties go to the language that sorts first; repeated rows and null ids give a row each; an empty table gives an
empty one; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import json
from collections import Counter, defaultdict
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import only, prepare, read_bytes, shared_dir, text_or_empty, write_bytes

#: Labelled rows of a fit; addend of a piece; cells (words x bytes) of a batch of words; bytes up to which words of a batch have equal lengths.
TRAIN_DOCS, ADDEND, CELLS, SHORT = 20_000, 0.05, 1 << 15, 32
#: Least score of a text whose language counts as told.
LEAST = 0.5
#: Scores (words x languages) that a worker remembers.
KNOWN = 1 << 18
SLOTS = 1 << 20
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Pieces:
    """All pieces of a vocabulary behind an open-addressing table of 64-bit hashes; piece 0 is none."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pieces = sorted({base64.b64decode(line.split()[0]) for line in f} - {b""})
        self.size, self.lengths = len(pieces) + 1, sorted({len(p) for p in pieces})
        hashes = []
        for p in pieces:
            h = 0
            for c in p:
                h = (h * int(BASE) + c + 1) % (1 << 64)
            hashes.append(h)
        if len(set(hashes)) < len(hashes):
            raise ValueError("two pieces share a hash")
        self.hash, self.id, self.probes = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32), 1
        for k, h in enumerate(hashes, 1):
            slot, n = (h * int(MIX)) % (1 << 64) >> 44, 1
            while self.id[slot]:
                slot, n = (slot + 1) % SLOTS, n + 1
            self.hash[slot], self.id[slot] = h, k
            self.probes = max(self.probes, n)

    def find(self, h: np.ndarray) -> np.ndarray:
        slot = (h * MIX >> np.uint64(44)).astype(np.int64)
        out = np.where(self.hash[slot] == h, self.id[slot], 0)
        todo = np.nonzero((out == 0) & (self.id[slot] != 0))[0]
        for n in range(1, self.probes):
            if not len(todo):
                break
            at = (slot[todo] + n) % SLOTS
            hit = self.hash[at] == h[todo]
            out[todo[hit]] = self.id[at[hit]]
            todo = todo[~hit & (self.id[at] != 0)]
        return out

    def spans(self, words: list[bytes]):
        """Every piece in words of ascending lengths: its place, word, length and number, in order of place.

        Also where the pieces of each place begin among them. A piece of one word never reaches into another.
        """
        sizes = np.array([len(w) for w in words])
        n = int(sizes[-1])
        text = np.frombuffer(b"".join(w.ljust(n, b"\0") for w in words), np.uint8).reshape(len(words), n).T.astype(np.uint64) + np.uint64(1)
        ahead = np.zeros((n + 1, len(words)), np.uint64)  # hash of each prefix
        for j in range(n):
            ahead[j + 1] = ahead[j] * BASE + text[j]
        out, power, done = [], 1, 0
        for k in self.lengths:
            if k > n:
                break
            power, done = power * pow(int(BASE), k - done, 1 << 64) % (1 << 64), k
            found = self.find((ahead[k:] - ahead[:-k] * np.uint64(power)).ravel()).reshape(n + 1 - k, len(words))
            j, w = (x.astype(np.int32) for x in np.nonzero(found))
            inside = j + k <= sizes[w]
            j, w = j[inside], w[inside]
            out.append((j, w, np.full(len(j), k, np.int32), found[j, w].astype(np.int32)))
        j, w, k, piece = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.argsort(j, kind="stable")
        j = j[order]
        return j, w[order], k[order], piece[order], np.searchsorted(j, np.arange(n + 1)), sizes


@lru_cache(maxsize=2)
def pieces_of(path: str) -> Pieces:
    return Pieces(path)


def _batches(words: list[str]):
    """Positions and bytes, the blank that leads a word included, of words in batches of like lengths."""
    raw = [b" " + w.encode() for w in words]
    order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
    at = 0
    while at < len(order):
        first, end = len(raw[order[at]]), at
        while end < len(order) and (n := len(raw[order[end]])) * (end - at + 1) <= max(CELLS, n) and (n == first if first <= SHORT else n <= 2 * first):
            end += 1
        yield order[at:end], [raw[i] for i in order[at:end]]
        at = end


def _forward(spans, prob: np.ndarray, longest: int, log_all: bool = False):
    """Log of the sum over the segmentations of each word, by language; with log_all also of each prefix.

    Sums are kept for as many places as a piece can reach; now and then each word's are scaled to keep them above zero.
    """
    j, w, k, piece, starts, sizes = spans
    n, ring = int(sizes[-1]), min(longest, int(sizes[-1])) + 1
    sums = np.zeros((ring, len(sizes), prob.shape[1]))
    sums[0] = 1
    scale, out = np.zeros(len(sizes)), np.full((len(sizes), prob.shape[1]), -np.inf)
    logs = np.full((n + 1, len(sizes)), -np.inf) if log_all else None
    ends = np.searchsorted(sizes, np.arange(n + 2))  # words of j bytes: ends[j] to ends[j + 1]
    for at in range(n + 1):
        here = sums[at % ring]
        if at and at % 8 == 0:
            low = sums.max(axis=(0, 2))
            low[low == 0] = 1
            sums /= low[:, None]
            scale += np.log(low)
        with np.errstate(divide="ignore"):
            if log_all:
                logs[at] = np.log(here[:, 0]) + scale
            if ends[at] < ends[at + 1]:
                done = slice(ends[at], ends[at + 1])
                out[done] = np.log(here[done]) + scale[done, None]
        if at < n:
            x = slice(starts[at], starts[at + 1])
            sums[(at + k[x]) % ring, w[x]] += here[w[x]] * prob[piece[x]]
        here[:] = 0  # the place that lies a ring further on
    return out, logs


def word_scores(pieces: Pieces, words: list[str], prob: np.ndarray) -> np.ndarray:
    """Log-probability of each word in each language. prob: pieces x languages, row 0 all zero."""
    out = np.zeros((len(words), prob.shape[1]))
    for where, raw in _batches(words):
        out[where] = _forward(pieces.spans(raw), prob, pieces.lengths[-1])[0]
    return out


def expected_counts(pieces: Pieces, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected piece counts of each language under equal probabilities. counts: words x languages."""
    prob = np.full((pieces.size, 1), 1 / pieces.size)
    out = np.zeros((pieces.size, counts.shape[1]))
    for where, raw in _batches(words):
        j, w, k, piece, starts, sizes = spans = pieces.spans(raw)
        total, ahead = _forward(spans, prob, pieces.lengths[-1], True)
        # the sums behind a place are those ahead of it in the reversed word
        turned = sizes[w] - j - k
        order = np.argsort(turned, kind="stable")
        back = (turned[order], w[order], k[order], piece[order], np.searchsorted(turned[order], np.arange(sizes[-1] + 1)), sizes)
        behind = _forward(back, prob, pieces.lengths[-1], True)[1]
        share = np.exp(ahead[j, w] + behind[sizes[w] - j - k, w] - np.log(pieces.size) - total[w, 0])
        weight = counts[where]
        for lang in range(counts.shape[1]):
            out[:, lang] += np.bincount(piece, share * weight[w, lang], pieces.size)
    return out


def _forget():
    pieces_of.cache_clear()
    _loaded.cache_clear()


def _fit_part(batches, path):
    only("langid", _forget)
    pieces, tallies = pieces_of(path), defaultdict(Counter)

    def flush():
        langs = sorted(tallies)
        words = sorted(set().union(*tallies.values()))
        counts = np.array([[tallies[x][w] for x in langs] for w in words], float).reshape(-1, len(langs))
        got = expected_counts(pieces, words, counts)
        piece, lang = np.nonzero(got > 0)
        tallies.clear()
        return pa.RecordBatch.from_arrays([pa.array([langs[k] for k in lang], pa.string()), pa.array(piece, pa.int32()), pa.array(got[piece, lang])], names=["lang", "piece", "n"])

    for b in batches:
        for lang, text in zip(b["lang"].to_pylist(), b["text"].to_pylist(), strict=True):
            tallies[lang].update(text.lower().split())
        if sum(map(len, tallies.values())) > 200_000:
            yield flush()
    if tallies:
        yield flush()


def fit(docs: DataFrame, train: Column, path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """(languages, pieces x languages probabilities) from rows where train holds and lang is not null."""
    prepare(docs.sparkSession)
    rows = docs.where(train & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    n = rows.count()
    if n > train_docs:
        rows = rows.where(F.pmod(F.xxhash64(F.col("id").cast("string"), "text"), F.lit(1 << 40)) < int((1 << 40) * train_docs / n))
    got = rows.select("text", "lang").mapInArrow(partial(_fit_part, path=path), "lang string, piece int, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(got["lang"]))
    prob = np.zeros((pieces_of(path).size, len(langs)))
    prob[got["piece"].to_numpy(int), [langs.index(x) for x in got["lang"]]] = got["n"]
    prob += ADDEND
    prob[0] = 0
    return langs, prob / prob.sum(axis=0) if langs else prob


class _Known(dict):
    """Row of a word in the table of scores; a new word gets the next row."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


class _Predictor:
    """Remembers the scores of the first words it meets, which are the frequent ones; later ones are scored anew."""

    def __init__(self, path: str, model: str):
        self.langs, self.prob = _loaded(model)
        self.most = KNOWN // (len(self.langs) or 1)
        self.pieces, self.known, self.table = pieces_of(path), _Known(), np.zeros((0, len(self.langs)))

    def __call__(self, texts: list[str]) -> tuple[list[str], list[float]]:
        langs, known = self.langs, self.known
        if not langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        split = [t.lower().split() for t in texts]
        flat = [w for words in split for w in words]
        rows = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
        if known.new:
            self.table = np.concatenate([self.table, word_scores(self.pieces, known.new, self.prob)])
            known.new.clear()
        total = np.zeros((len(texts), len(langs)))
        sizes = np.array([len(x) for x in split], int)
        full, starts = sizes > 0, np.cumsum(sizes) - sizes
        if len(flat):
            total[full] = np.add.reduceat(self.table[rows], starts[full], axis=0)
        pred, score = [], []
        for t, row in zip(texts, total, strict=True):
            if not any(map(str.isalpha, t)):
                pred.append("und")
                score.append(0.0)
            else:
                k = int(row.argmax())
                pred.append(langs[k])
                score.append(float(1 / np.exp(row - row[k]).sum()))
        if len(known) > self.most:
            for w in list(known)[self.most :]:
                del known[w]
            self.table = self.table[: self.most]
        return pred, score


def _saved(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> str:
    """A model as a file of the shared folder: vocabulary x languages x 4 bytes, whatever the number of languages."""
    folder = shared_dir(docs.sparkSession, "langid-model")
    langs, prob = model
    write_bytes(f"{folder}/model", [json.dumps(langs).encode() + b"\n", prob.astype("<f4").tobytes()])
    return f"{folder}/model"


@lru_cache(maxsize=2)
def _loaded(uri: str) -> tuple[list[str], np.ndarray]:
    head, _, raw = read_bytes(uri).partition(b"\n")
    langs = json.loads(head)
    return langs, np.frombuffer(raw, "<f4").reshape(-1, len(langs)) if langs else np.zeros((0, 0))


def _predict(batches, path, model):
    only("langid", _forget)
    predictor = _Predictor(path, model)
    for b in batches:
        pred, score = predictor(b["text"].to_pylist())
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["id", "lang_pred", "score"])


def _keep(batches, path, model, text_col, lang_col, least):
    only("langid", _forget)
    predictor = _Predictor(path, model)
    for b in batches:
        texts = [t or "" for t in b[text_col].to_pylist()]
        if predictor.langs:
            pred, score = predictor(texts)
            keep = [p != "und" and s >= least for p, s in zip(pred, score, strict=True)]
            if lang_col in b.schema.names:
                at = b.schema.get_field_index(lang_col)
                told = pa.array([p if x is None else x for x, p in zip(b[lang_col].to_pylist(), pred, strict=True)], b.schema.field(at).type)
                b = b.set_column(at, b.schema.field(at), told)
        else:
            keep = [any(map(str.isalpha, t)) for t in texts]
        yield b.filter(pa.array(keep, pa.bool_()))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row, from its text alone."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(partial(_predict, path=path, model=_saved(docs, model)), f"id {dict(rows.dtypes)['id']}, lang_pred string, score double").withColumnRenamed("id", id_col)


def identified(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str, text_col: str = "text", lang_col: str = "lang", least: float = LEAST) -> DataFrame:
    """The rows, with all their columns, whose language the model tells with a score of at least `least`.

    Where lang_col, a column of strings, is null it gets the prediction. Of a model that could learn nothing (no row has a
    language) no choice is asked: rows with a letter stay.
    """
    prepare(docs.sparkSession)
    told = lang_col if dict(docs.dtypes).get(lang_col) == "string" else ""
    return docs.mapInArrow(partial(_keep, path=path, model=_saved(docs, model), text_col=text_col, lang_col=told, least=least), docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2
