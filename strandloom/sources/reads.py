"""FASTA and FASTQ files as tables, and library files."""

from __future__ import annotations

import configparser
import gzip
import io
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes that a reader takes from a file at a time, and bases that it gathers before it sends them on.
BUFFER = 1 << 20
SCHEMA = "path string, name string, comment string, seq string, qual string"


def records(lines: Iterator[str]) -> Iterator[tuple[str, str, str, str | None]]:
    """(name, comment, sequence, qualities or None). Sequences and qualities may span lines; a quality line may start
    with '@', as qualities are read up to the length of the sequence. A quality that is too short or long is an error."""
    line = next(lines, None)
    while line is not None:
        if line[:1] not in (">", "@"):
            line = next(lines, None)
            continue
        name, _, comment = line[1:].rstrip("\r\n").partition(" ")
        seq: list[str] = []
        line = next(lines, None)
        while line is not None and line[:1] not in (">", "@", "+"):
            seq.append("".join(c for c in line if c.isprintable() and not c.isspace()))
            line = next(lines, None)
        whole = "".join(seq)
        if line is None or line[0] != "+":
            yield name, comment, whole, None
            continue
        qual = ""
        while len(qual) < len(whole):
            if (line := next(lines, None)) is None:
                raise ValueError(f"record {name} ends within its qualities")
            qual += line.rstrip("\r\n")
        if len(qual) != len(whole):
            raise ValueError(f"record {name} has {len(whole)} bases and {len(qual)} qualities")
        yield name, comment, whole, qual
        line = next(lines, None)


def _opened(path: str):
    """A stream over a file's bytes, from the place that its path names."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return open("/" + path.removeprefix("file:").lstrip("/"), "rb")
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_stream(name, compression=None)


def _parse(batches):
    """Records of files, a few at a time: neither a file nor what it unpacks to is ever held whole."""
    import pyarrow as pa

    schema = pa.schema([(c, pa.string()) for c in ("path", "name", "comment", "seq", "qual")] + [("num", pa.int64())])
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    for b in batches:
        for path in b["path"].to_pylist():
            raw = io.BufferedReader(_opened(path), BUFFER)
            packed = raw.peek(2)[:2] == b"\x1f\x8b"
            text = io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if packed else raw, encoding="ascii", errors="replace")
            rows, held = [], 0
            for num, r in enumerate(records(iter(text))):
                rows.append((path, *r, num))
                held += len(r[2])
                if len(rows) == 5000 or held > BUFFER:
                    yield made(rows)
                    rows, held = [], 0
            if rows:
                yield made(rows)
            text.close()


def read_fastx(spark: SparkSession, *paths: str, numbered: bool = False) -> DataFrame:
    """All records of FASTA or FASTQ files of any size, gzipped or not; a file is one task, as gzip can't be split, and is streamed.

    Where asked for, num is a record's place in its file, from 0.
    """
    got = spark.read.format("binaryFile").load(list(paths)).select("path").mapInArrow(_parse, SCHEMA + ", num long")
    return got if numbered else got.drop("num")


def parse_libraries(text: str) -> tuple[dict, list[dict]]:
    """(global settings, libraries) of an INI text whose [LIB] sections repeat; ';' and '#' start comments."""
    settings: dict = {}
    libraries: list[dict] = []
    parts, held = [], []
    for line in text.splitlines():
        if line.strip().startswith("["):
            parts.append(held := [])
        held.append(line)
    for part in parts:
        ini = configparser.ConfigParser(inline_comment_prefixes=(";", "#"), interpolation=None)
        ini.read_string("\n".join(part))
        name = ini.sections()[0]
        values = dict(ini[name])
        if name == "global_setting":
            settings = {"max_rd_len": int(values["max_rd_len"])}
            continue
        if name != "LIB":
            raise ValueError(f"unknown section {name}")
        missing = [k for k in ("name", "diverse_rd_len", "asm_flag", "seq_profile", "qual_benchmark") if k not in values]
        if missing:
            raise ValueError(f"library {values.get('name')} lacks {', '.join(missing)}")
        lib = {k: int(values[k]) for k in ("diverse_rd_len", "asm_flag", "seq_profile", "qual_benchmark")} | {"name": values["name"], "paired": "avg_insert_len" in values}
        lib |= {"insert_size": int(values.get("avg_insert_len", 0)), "insert_sd": int(values.get("insert_sd", 0))}
        lib["files"] = [values[k] for k in sorted((k for k in values if k.removeprefix("s").startswith("f") and k.removeprefix("s")[1:].isdigit()), key=lambda k: (k[0] == "s", int(k.lstrip("sf"))))]
        allowed = {"diverse_rd_len": (0, 1), "asm_flag": (1, 2, 3), "seq_profile": (1, 2), "qual_benchmark": (33, 64)}
        for k, v in allowed.items():
            if lib[k] not in v:
                raise ValueError(f"library {lib['name']}: {k} is {lib[k]}, not one of {v}")
        if any(x["name"] == lib["name"] for x in libraries):
            raise ValueError(f"two libraries are called {lib['name']}")
        if not lib["files"]:
            raise ValueError(f"library {lib['name']} names no file")
        libraries.append(lib)
    if "max_rd_len" not in settings:
        raise ValueError("max_rd_len is missing")
    return settings, libraries


def libraries(spark: SparkSession, text: str) -> DataFrame:
    """(lib_id, name, paired, insert_size, insert_sd, diverse_rd_len, asm_flag, seq_profile, qual_benchmark, files) of a library text, in its order."""
    _, libs = parse_libraries(text)
    kinds = {"name": "string", "paired": "boolean", "insert_size": "int", "insert_sd": "int", "diverse_rd_len": "int", "asm_flag": "int", "seq_profile": "int", "qual_benchmark": "int", "files": "array<string>"}
    return spark.createDataFrame([(i, *(lib[c] for c in kinds)) for i, lib in enumerate(libs)], "lib_id int, " + ", ".join(f"{c} {t}" for c, t in kinds.items()))
