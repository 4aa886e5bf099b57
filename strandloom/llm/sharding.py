"""Shards of a growing table: arrivals become small immutable files, size-tiered compaction merges them.

A store is a folder of Parquet shards and of manifests, one for each version, that list its shards. An arrival is
written first and then named in a new manifest; compaction merges runs of shards of a similar size (a tier spans a
factor of FANOUT) until files are near the target, again under names of their own, and commits one more manifest.

A manifest names lists of shards, each a small file that is never changed: an arrival writes a list of its own shards
alone, and only compaction writes all lists anew, so a commit costs what it adds (and a name for each list). A manifest
appears under its final name in one step and never replaces another, so readers see whole versions only; of two writers
one finds its version taken, reads the newer manifest and tries again on that. An append always can; a compaction can
where its inputs are still listed, else its files are given up.

A merge streams its inputs batch by batch in one task; a task that is run again writes a file of another name, which no
manifest lists. Vacuum deletes files that no kept version lists, but only those older than an age, so files that a
writer has not committed yet stay.

Defined results: nulls, empty and very long texts, repeated rows and all columns, whatever their names, are kept as they
are; an empty arrival adds a version without shards; a store without versions can't be read, one without shards is an
empty table of its schema; an arrival of other columns than the store's is an error.
"""

from __future__ import annotations

import json
import math
import time
import uuid
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.llm.common import file_system, prepare, shared_dir

#: Bytes of a file to aim at; shards of one tier that start a merge; bytes of the lowest tier; seconds for which vacuum spares a file.
TARGET, FANOUT, LOWEST, AGE = 64 << 20, 4, 1 << 20, 24 * 3600


class Taken(Exception):
    """Another writer has committed the version."""


def tier(size: int) -> int:
    """0 up to LOWEST bytes, then one more for each factor of FANOUT."""
    return max(0, math.ceil(math.log(max(size, 1) / LOWEST, FANOUT) - 1e-9))


def plan(sizes: dict[str, int], target: int = TARGET, fanout: int = FANOUT) -> list[list[str]]:
    """Groups of shards to merge, from their sizes: tiers from the lowest up, in each runs of `fanout` or more in order
    of name, cut at the target; what a merge would make takes part in its own tier. Each shard is rewritten once."""
    shards = [(name, size, [name]) for name, size in sorted(sizes.items())]
    level = 0
    while level <= tier(target):
        here = [s for s in shards if tier(s[1]) <= level and s[1] < target // 2]
        if len(here) < fanout:
            level += 1
            continue
        merged, run = [], []
        for s in here:
            if run and (sum(x[1] for x in run) + s[1] > target):
                merged.append(run)
                run = []
            run.append(s)
        merged.append(run)
        left = [s for s in shards if s not in here]
        made = [(run[0][0], sum(x[1] for x in run), [n for x in run for n in x[2]]) for run in merged]
        if len(made) == len(here):
            level += 1
        shards = sorted(left + made)
    return [members for _, _, members in shards if len(members) > 1]


def _merge(batches, folder, schema):
    import pyarrow.parquet as pq

    for b in batches:
        for group, uris in zip(b["group"].to_pylist(), b["uris"].to_pylist(), strict=True):
            uri = f"{folder}/data/merged-{group:06d}-{uuid.uuid4().hex}.parquet"
            store, path = file_system(uri)
            store.create_dir(path.rpartition("/")[0], recursive=True)
            rows, writer = 0, None
            with store.open_output_stream(path) as out:
                for source in uris:
                    with file_system(source)[0].open_input_file(file_system(source)[1]) as f:
                        for part in pq.ParquetFile(f).iter_batches(batch_size=2000):
                            writer = writer or pq.ParquetWriter(out, part.schema, compression="zstd")
                            writer.write_batch(part, row_group_size=50_000)
                            rows += part.num_rows
                if writer:
                    writer.close()
            yield pa.RecordBatch.from_pydict({"uri": [uri], "bytes": [store.get_file_info(path).size], "n_rows": [rows], "inputs": [uris]}, schema=pa.schema([("uri", pa.string()), ("bytes", pa.int64()), ("n_rows", pa.int64()), ("inputs", pa.list_(pa.string()))]))


class ShardStore:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        prepare(spark)
        self.spark, folder = spark, folder or shared_dir(spark, "shards")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(folder).getFileSystem(self._conf)
        self.folder = self._fs.makeQualified(self._path(folder)).toString()  # one spelling for all names of a file

    def versions(self) -> list[int]:
        where = self._path(f"{self.folder}/manifest")
        if not self._fs.exists(where):
            return []
        return sorted(int(n[1:-5]) for s in self._fs.listStatus(where) if (n := s.getPath().getName()).startswith("v") and n.endswith(".json"))

    def _json(self, name: str) -> dict | list:
        stream = self._fs.open(self._path(f"{self.folder}/{name}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _put(self, name: str, content) -> None:
        out = self._fs.create(self._path(f"{self.folder}/{name}"), False)
        try:
            out.write(bytearray(json.dumps(content).encode()))
        finally:
            out.close()

    def _listed(self, shards: list[dict]) -> list[str]:
        """Writes a list of shards; its name in a list, or nothing for none."""
        if not shards:
            return []
        name = f"lists/{uuid.uuid4().hex}.json"
        self._put(name, shards)
        return [name]

    def manifest(self, version: int | None = None) -> dict:
        """Version, schema, names of the lists and the shards that they list."""
        if version is None:
            version = max(self.versions(), default=0)
        if not version:
            return {"version": 0, "schema": None, "lists": [], "shards": []}
        got = self._json(f"manifest/v{version:08d}.json")
        return got | {"shards": [s for name in got["lists"] for s in self._json(name)]}

    def _commit(self, base: int, lists: list[str], schema: str) -> int:
        """The version after base, whole or not at all; an error if another writer has made it."""
        jvm, version = self.spark.sparkContext._jvm, base + 1
        temp = f"manifest/.{uuid.uuid4().hex}.tmp"
        self._put(temp, {"version": version, "schema": schema, "lists": lists})
        temp, final = (self._path(f"{self.folder}/{n}") for n in (temp, f"manifest/v{version:08d}.json"))
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri() if temp.toUri().getScheme() else self._fs.getUri(), self._conf).rename(temp, final, options)
        except Exception as e:
            self._fs.delete(temp, False)
            if self._fs.exists(final):
                raise Taken(f"version {version} already exists") from e
            raise
        return version

    def _retried(self, change) -> int:
        """Commits change(newest manifest), lists and schema, on whatever version is the newest; None commits nothing."""
        while True:
            base = self._head()
            got = change(base)
            if got is None:
                return base["version"]
            try:
                return self._commit(base["version"], *got)
            except Taken:
                continue

    def _head(self) -> dict:
        """The newest manifest without its shards."""
        version = max(self.versions(), default=0)
        return self._json(f"manifest/v{version:08d}.json") if version else {"version": 0, "schema": None, "lists": []}

    def append(self, arrivals: DataFrame, by: str | None = None) -> int:
        """Adds the rows; with `by`, a column that tells arrivals apart, each value is committed as a version of its own."""
        where = f"{self.folder}/data/arrival-{uuid.uuid4().hex}"
        schema = (arrivals.drop(by) if by else arrivals).schema.json()
        if (known := self._head()["schema"]) and known != schema:
            raise ValueError("the arrival's columns are not those of the store")
        arrivals.write.option("maxRecordsPerFile", 20_000).parquet(where, partitionBy=[by] if by else None)
        files, todo = {}, [self._path(where)]
        while todo:
            for s in self._fs.listStatus(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                elif s.getPath().getName().startswith("part-") and s.getLen():
                    uri = s.getPath().toString()
                    files.setdefault(uri.removeprefix(where).rpartition("/")[0], []).append({"uri": uri, "bytes": s.getLen()})
        for _, shards in sorted(files.items()) or [("", [])]:
            new = self._listed(sorted(shards, key=lambda s: s["uri"]))
            version = self._retried(lambda base, new=new: (base["lists"] + new, base["schema"] or schema))
        return version

    def compact(self, target: int = TARGET, fanout: int = FANOUT) -> int:
        """Merges similar shards and commits the result; returns the version in force."""
        base = self.manifest()
        groups = plan({s["uri"]: s["bytes"] for s in base["shards"]}, target, fanout)
        if not groups:
            return base["version"]
        work = self.spark.createDataFrame(list(enumerate(groups)), "group long, uris array<string>").repartition(len(groups), "group")
        made = work.mapInArrow(partial(_merge, folder=self.folder, schema=base["schema"]), "uri string, bytes long, n_rows long, inputs array<string>").collect()
        gone = {u for r in made for u in r.inputs}
        merged = [{"uri": r.uri, "bytes": r.bytes} for r in sorted(made, key=lambda r: r.uri) if r.n_rows]

        def change(head):
            now = self.manifest(head["version"])
            if not gone <= {s["uri"] for s in now["shards"]}:
                return None  # another compaction was faster
            return self._listed([s for s in now["shards"] if s["uri"] not in gone] + merged), head["schema"]

        return self._retried(change)

    def vacuum(self, keep: int = 1, older: float = AGE) -> int:
        """Deletes manifests before the last `keep` versions, and files over `older` seconds old that no kept one names."""
        versions = self.versions()
        kept = [self.manifest(v) for v in versions[-keep:]]
        named = {s["uri"] for m in kept for s in m["shards"]} | {f"{self.folder}/{name}" for m in kept for name in m["lists"]}
        n, limit = 0, time.time() - older
        for v in versions[:-keep]:
            n += self._fs.delete(self._path(f"{self.folder}/manifest/v{v:08d}.json"), False)
        todo = [p for p in (self._path(f"{self.folder}/{d}") for d in ("data", "lists")) if self._fs.exists(p)]
        while todo:
            for s in self._fs.listStatus(todo.pop()):
                if s.isDirectory():
                    todo.append(s.getPath())
                elif s.getPath().toString() not in named and s.getModificationTime() / 1000 <= limit:
                    n += self._fs.delete(s.getPath(), False)
        return n

    def read(self, version: int | None = None) -> DataFrame:
        from pyspark.sql.types import StructType

        at = self.manifest(version)
        if not at["schema"]:
            raise ValueError(f"{self.folder} has no version yet")
        schema = StructType.fromJson(json.loads(at["schema"]))
        if not at["shards"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s["uri"] for s in at["shards"]])


def sharded(docs: DataFrame, id_col: str = "doc_id", arrivals: int = 8, target: int = TARGET) -> DataFrame:
    """The documents read back from a store of their own that they reached in several arrivals and that was then compacted."""
    store, by = ShardStore(docs.sparkSession), "arrival"
    while by.lower() in map(str.lower, docs.columns):
        by += "_"
    store.append(docs.withColumn(by, F.pmod(F.xxhash64(F.col(id_col).cast("string")), F.lit(arrivals))), by=by)
    store.compact(target)
    store.vacuum(older=0)  # nobody else writes to this store
    return store.read()
