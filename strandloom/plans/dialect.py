"""One text for two SQL engines: each query is written once, with a macro where the dialects part.

RANGE(lo; hi) makes a row for each whole number from lo to hi, none if hi is smaller.
LETTERS(text, pattern, new;ALL) replaces every match of a pattern.
"""

from __future__ import annotations


def _ranges(text: str, form: str) -> str:
    while (at := text.find("RANGE(")) >= 0:
        depth, middle, k = 0, 0, at + len("RANGE(")
        while depth or text[k] != ")":
            depth += {"(": 1, ")": -1}.get(text[k], 0)
            if text[k] == ";" and not depth:
                middle = k
            k += 1
        lo, hi = text[at + len("RANGE(") : middle].strip(), text[middle + 1 : k].strip()
        text = text[:at] + form.format(lo=lo, hi=hi) + text[k + 1 :]
    return text


def spark_sql(text: str) -> str:
    form = "explode(CASE WHEN {hi} >= {lo} THEN sequence(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT)) ELSE CAST(array() AS ARRAY<BIGINT>) END)"
    return _ranges(text, form).replace("LETTERS(", "regexp_replace(").replace(";ALL)", ")")


def duckdb_sql(text: str) -> str:
    return _ranges(text, "unnest(range(CAST({lo} AS BIGINT), CAST({hi} AS BIGINT) + 1))").replace("LETTERS(", "regexp_replace(").replace(";ALL)", ", 'g')")
