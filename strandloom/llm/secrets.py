"""Secrets in whole texts: strong patterns by themselves, weak candidates only together with their complements.

A credential often has several parts: an identifier (who), a secret (proof) and an endpoint (where). Weak candidates
for a part are too common to report alone. So spans of a document are joined as intervals within scopes: two spans share
a scope when at most REACH characters and no blank line lie between them. Then
  an identifier is reported if a secret shares its scope,
  a weak secret if an identifier or an endpoint does,
  an endpoint if an identifier and a secret do.
The join is a sweep over sorted spans and asks only whether a complement exists, so it makes no pairs.

Kinds, in order: assign, access, hex (strong, always reported), ident, short, blob, endpoint (weak). A weak span that
overlaps a strong one is none. Offsets are code points, ends exclusive.

Defined results: a null or empty text has no spans; repeated rows and null ids give a row each; an empty table gives an
empty one; other columns, whatever their names, are not read (redaction passes them on).
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import partial
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import only, prepare, text_or_empty

REACH = 200
KINDS = ["assign", "access", "hex", "ident", "short", "blob", "endpoint"]
STRONG = KINDS[:3]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
IDENT = re.compile(r"""\b(user(?:name)?|login|account|client_?id|key_?id|access_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.I | re.A)
BLOB = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?![A-Za-z0-9+/_-])")
ENDPOINT = re.compile(r"""\bhttps?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[A-Za-z0-9._~/-]*)?|\b(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]{4,}""", re.I | re.A)
BLANK = re.compile(r"\n[ \t\r]*\n")


def _mixed(word: str) -> bool:
    return any(map(str.isdigit, word)) and any(map(str.isupper, word)) and any(map(str.islower, word))


class Scope:
    """Sorted starts of spans with the furthest end up to each; answers whether one shares a span's scope."""

    def __init__(self, spans: list[tuple[int, int]], blanks: list[int]):
        self.blanks, self.spans = blanks, sorted(spans)
        self.starts = [s for s, _ in self.spans]
        self.ends = sorted((e, s) for s, e in self.spans)
        self.furthest = list(accumulate((e for _, e in self.spans), max))

    def near(self, start: int, end: int) -> bool:
        """Whether another span overlaps, or lies within reach and on the same side of every blank line."""
        k = bisect_left(self.starts, end)
        if k and self.furthest[k - 1] > start:
            return True
        lo, hi = bisect_left(self.ends, (start - REACH, -1)), bisect_right(self.starts, end + REACH)
        before = self.ends[lo : bisect_right(self.ends, (start, start))][-1:]  # the nearest one before
        after = self.spans[bisect_left(self.starts, end) : hi][:1]  # the nearest one after
        return any(self._joined(e, start) for e, _ in before) or any(self._joined(end, s) for s, _ in after)

    def _joined(self, a: int, b: int) -> bool:
        k = bisect_left(self.blanks, a)
        return k == len(self.blanks) or self.blanks[k] >= b


def find(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind."""
    found: list[tuple[str, int, int]] = []
    pairs = ":" in text or "=" in text
    assigned = [m for m in ASSIGN.finditer(text)] if pairs else []
    found += [("assign", *m.span()) for m in assigned if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    strong = sorted((s, e) for _, s, e in found)
    idents = [m.span() for m in IDENT.finditer(text)] if pairs else []
    if pairs or "AKIA" in text:
        found += _weak(text, found, strong, assigned, idents)
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _weak(text, found, strong, assigned, idents):
    starts, furthest = [s for s, _ in strong], []
    for _, e in strong:
        furthest.append(max(e, furthest[-1] if furthest else 0))

    def free(span):
        k = bisect_left(starts, span[1])
        return not k or furthest[k - 1] <= span[0]

    idents = [x for x in idents if free(x)]
    short = [m.span() for m in assigned if 6 <= len(m[2]) < 12 and free(m.span())]
    endpoint = [m.span() for m in ENDPOINT.finditer(text) if free(m.span())]
    blob = [m.span() for m in BLOB.finditer(text) if _mixed(m[0]) and free(m.span())] if idents or endpoint or "AKIA" in text else []
    blanks = [m.start() for m in BLANK.finditer(text)]
    who = Scope(idents + [(s, e) for k, s, e in found if k == "access"], blanks)
    proof = Scope(short + blob + [(s, e) for k, s, e in found if k in ("assign", "hex")], blanks)
    where = Scope(endpoint, blanks)
    out = [("ident", *x) for x in idents if proof.near(*x)]
    out += [(kind, *x) for kind, spans in (("short", short), ("blob", blob)) for x in spans if who.near(*x) or where.near(*x)]
    return out + [("endpoint", *x) for x in endpoint if who.near(*x) and proof.near(*x)]


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches):
    for b in batches:
        spans = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in b["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([b["id"], pa.array(spans, SPANS)], names=["id", "spans"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row."""
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(_scan, f"id {dict(rows.dtypes)['id']}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the strong kinds and spans as text, kind:start:end joined by commas."""
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["kind"].isin(STRONG))
    return found.select(id_col, *map(count, STRONG), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def redacted(text: str, mark: str = "[{}]") -> str:
    """The text with every span, overlapping ones as one, replaced by the kind of the first."""
    out, at = [], 0
    for kind, s, e in find(text):
        if s >= at:
            out += [text[at:s], mark.format(kind)]
        at = max(at, e)
    return "".join(out) + text[at:]


def _redact(batches, text_col, length_col):
    only()
    for b in batches:
        texts = [t if t is None else redacted(t) for t in b[text_col].to_pylist()]
        new = {text_col: pa.array(texts, b.schema.field(text_col).type)}
        if length_col:
            new[length_col] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(length_col).type)
        yield pa.RecordBatch.from_arrays([new.get(c, b.column(k)) for k, c in enumerate(b.schema.names)], schema=b.schema)


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """The same rows and columns with secrets replaced; length_col, if given, gets the new number of characters."""
    prepare(docs.sparkSession)
    return docs.mapInArrow(partial(_redact, text_col=text_col, length_col=length_col), docs.schema)
