"""Token ids of public tokenizers, word by word with a cache, equal to what the library gives for the whole text.

Both vocabulary files split a text into words before their merges, and a blank between two characters that are not
white space always starts a new word, whatever stands around it. So ids of a text are the ids of its blank-separated
parts one after the other. A part that is empty or has white space at an end breaks that rule; its text is then cut at
the sound blanks only.
"""

from __future__ import annotations

import base64
import json
import os
import re
import struct
from functools import lru_cache

import numpy as np

from strandloom.llm.common import only

#: Parts that a worker remembers; later ones are encoded anew each time, which changes time but no result.
CACHE_PARTS = 300_000
SOUND_BLANK = re.compile(r"(?<=\S) (?=\S)")


class _Unsound(Exception):
    pass


def _quick_bytes(path: str):
    """Ids of a part by the rank file of the same vocabulary, if one lies beside it: the same merges in a faster library.

    Parts that may hold a special token's string go to the .json file's own library.
    """
    ranks = f"{path.removesuffix('.json')}.tiktoken"
    try:
        import public_tokenizers
        import tiktoken
    except ImportError:
        return None
    if not os.path.exists(ranks):
        return None
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
    return lambda part: None if "<|" in part else plain(part)


#: A word of Latin letters that lower-casing and NFC treat alike in every library, then marks that form one word.
LATIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*)([.,;:!?)\"-]*)")
WORD_END = b"\xff"  # a byte that UTF-8 never uses stands for the end-of-word suffix


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def _quick_words(path: str):
    """Ids of a Latin part by the merges of a vocabulary with word ends, in a faster library.

    A word's last byte joins the end marker before any other merge, as it does in a vocabulary with an end-of-word suffix.
    """
    try:
        import tiktoken
    except ImportError:
        return None
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    end, byte = model["end_of_word_suffix"], _byte_letters()
    if not end:
        return None
    single, joined = [], []
    for token, i in model["vocab"].items():
        ends = token.endswith(end) and token != end
        raw = bytes(byte[c] for c in (token.removesuffix(end) if ends else token)) + WORD_END * ends
        if raw != WORD_END:  # that byte's own letter can't occur in UTF-8
            (single if len(raw) <= 1 + ends else joined).append((i, raw))
    table, ids = {WORD_END: 0}, [0]
    for i, raw in [*sorted(single, key=lambda x: (not x[1].endswith(WORD_END), x[0])), *sorted(joined)]:
        table[raw] = len(ids)
        ids.append(i)
    core = tiktoken.Encoding("words", pat_str=r".+", mergeable_ranks=table, special_tokens={})._core_bpe

    def quick(part: str):
        if not (m := LATIN.fullmatch(part)):
            return None
        return [ids[k] for word in m.groups() if word for k in core.encode_single_piece(word.lower().encode() + WORD_END)]

    return quick


class PartCache(dict):
    """Ids of a part as little-endian unsigned 32-bit bytes. glue: what the tokenizer sees before a part that follows a blank."""

    def __init__(self, tokenizer, glue: str, quick=None):
        super().__init__()
        self.tokenizer, self.glue, self.quick, self.strict = tokenizer, glue, quick, True

    def fresh(self, text: str) -> bytes:
        ids = self.quick(text) if self.quick else None
        if ids is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, part: str) -> bytes:
        if self.strict and (not part or part[0].isspace() or part[-1].isspace()):
            raise _Unsound
        got = self.fresh(self.glue + part)
        if len(self) < CACHE_PARTS and len(part) < 64:
            self[part] = got
        return got


class Encoder:
    """path: a .json file for the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.blank_leads = self.tokenizer.normalizer is None  # else white space is dropped before the words are cut
        quick = _quick_bytes(path) if self.blank_leads else _quick_words(path)
        self.parts = PartCache(self.tokenizer, " " if self.blank_leads else "", quick)

    def pack(self, text: str) -> bytes:
        """All ids of a text, 4 bytes each."""
        if not text:
            return b""
        parts = self.parts
        try:
            if not self.blank_leads:
                return b"".join(map(parts.__getitem__, text.replace("\n", " ").split(" ")))
            head, *rest = text.split(" ")
            if not head or head[0].isspace() or head[-1].isspace():
                raise _Unsound
            return parts.fresh(head) + b"".join(map(parts.__getitem__, rest))
        except _Unsound:
            head, *rest = SOUND_BLANK.split(text)
            parts.strict = False
            try:
                return parts.fresh(head) + b"".join(x if (x := parts.get(p)) is not None else parts.fresh(parts.glue + p) for p in rest)
            finally:
                parts.strict = True


_encoder = lru_cache(maxsize=4)(Encoder)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file, until a task of another operator begins there."""
    only("tokens", _encoder.cache_clear)
    return _encoder(path)
