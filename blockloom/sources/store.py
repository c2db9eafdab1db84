"""Block tables as Parquet files with a versioned manifest.

A table revision is a folder: ``data/`` holds a folder of Parquet files for each
segment, written by as many tasks as the rows come in; ``manifest/`` holds
numbered JSON versions that list the segments.  A commit writes its files first
and the next manifest last, by a rename that fails if the version exists;
readers hold on to the version they began with.  ``active`` names the revision
that readers get and is replaced in one step.  Files that a commit replaces go on the
manifest's list of garbage and are removed after a lock time.

Works on any file system that Spark reads, through its Hadoop API.
"""

from __future__ import annotations

import json
import os
import tempfile
import time
import uuid
from dataclasses import asdict

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..chain import BlockRange, Segment, Size, canonical_chain, compaction_groups, joined, missing_ranges

BLOCK = "_block_num"
#: Compaction writes files of so many bytes at most, about.
FILE_BYTES = 256 << 20
#: A task of a compaction sorts about so many bytes of rows at most, by their schema or four times their files.
SORT_BYTES = 128 << 20
#: Where only the bytes of compressed files are known, a task sorts the rows of so many at most, about.
TASK_BYTES = 8 << 20


class Files:
    """Small files and folders through Spark's Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def list(self, name: str) -> list[tuple[str, int, float]]:
        path = self._path(name)
        if not self.fs.exists(path):
            return []
        return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime() / 1000) for s in self.fs.listStatus(path))

    def read(self, name: str) -> str | None:
        path = self._path(name)
        if not self.fs.exists(path):
            return None
        stream = self.fs.open(path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool = False) -> bool:
        """Write under a passing name, then rename in one step; False if the name is taken."""
        part, target = self._path(f"{name}.{uuid.uuid4().hex}.part"), self._path(name)
        self.fs.mkdirs(target.getParent())
        stream = self.fs.create(part, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        kinds = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kinds, 1)
        options[0] = kinds.OVERWRITE if replace else kinds.NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri(), self.spark._jsc.hadoopConfiguration())
        try:
            context.rename(part, target, options)
        except Py4JJavaError as e:
            self.fs.delete(part, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)


class Table:
    """One table of a store."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, start_block: int | None = None) -> None:
        self.spark, self.schema, self.start_block = spark, schema, start_block
        self.files = Files(spark, root)
        if self.files.read("active") is None:
            self.create_revision(activate=True)

    # Revisions ------------------------------------------------------------------

    @property
    def revision(self) -> str:
        return self.files.read("active") or ""

    def create_revision(self, activate: bool = False) -> str:
        name = f"r-{time.time_ns()}"
        self.files.write(f"{name}/manifest/{0:012d}.json", json.dumps({"segments": [], "garbage": []}))
        if activate:
            self.activate(name)
        return name

    def activate(self, revision: str) -> None:
        self.files.write("active", revision, replace=True)

    def deactivate(self) -> None:
        self.files.write("active", "", replace=True)

    def revisions(self) -> list[str]:
        return [n for n, _, _ in self.files.list("") if n.startswith("r-")]

    def prune(self) -> None:
        """Delete all revisions but the active one."""
        for r in self.revisions():
            if r != self.revision:
                self.files.delete(r)

    def truncate(self) -> None:
        """An empty new revision becomes active; the old one is deleted."""
        old = self.revision
        self.create_revision(activate=True)
        self.files.delete(old)

    # The manifest ------------------------------------------------------------------

    def _state(self) -> tuple[int, dict]:
        versions = [n for n, _, _ in self.files.list(f"{self.revision}/manifest") if n.endswith(".json")]
        last = versions[-1]
        return int(last[:-5]), json.loads(self.files.read(f"{self.revision}/manifest/{last}"))

    def _commit(self, change, tries: int = 20) -> None:
        for _ in range(tries):
            version, state = self._state()
            if self.files.write(f"{self.revision}/manifest/{version + 1:012d}.json", json.dumps(change(state))):
                return
        raise RuntimeError("the manifest changes too often")

    @staticmethod
    def _segment(d: dict) -> Segment:
        return Segment(d["path"], BlockRange.from_json(d["range"]), d["modified"], Size(**d["size"]))

    @staticmethod
    def _json(s: Segment) -> dict:
        return {"path": s.path, "range": s.range.to_json(), "modified": s.modified, "size": asdict(s.size)}

    def segments(self) -> list[Segment]:
        return [self._segment(d) for d in self._state()[1]["segments"]]

    def canonical(self) -> list[Segment]:
        return canonical_chain(self.segments(), self.start_block)

    def synced(self) -> tuple[int, int] | None:
        chain = self.canonical()
        return (chain[0].range.start, chain[-1].range.end) if chain else None

    def missing(self, start: int, end: int) -> list[tuple[int, int]]:
        return missing_ranges(self.segments(), (start, end), self.start_block)

    # Data ------------------------------------------------------------------------------

    def _write(self, df: DataFrame, files: int | None = None) -> tuple[str, int, int]:
        """Write a segment's folder, a file a task (or so many files, by ranges of blocks), each in block order; its path, bytes and rows."""
        path = f"{self.revision}/data/{uuid.uuid4().hex}"
        dealt = df.repartitionByRange(files, BLOCK) if files else df
        dealt.sortWithinPartitions(BLOCK).write.option("compression", "zstd").parquet(f"{self.files.root}/{path}")
        size = self._bytes(path)
        rows = self.spark.read.schema(self.schema).parquet(f"{self.files.root}/{path}").count() if size else 0  # from the footers
        if not rows:
            self.files.delete(path)
        return path, size if rows else 0, rows

    def _bytes(self, path: str) -> int:
        return sum(size for n, size, _ in self.files.list(path) if n.endswith(".parquet"))

    def _parts(self, size: Size) -> int:
        """How many files so much is written to, so that neither a file nor the sort of its rows is large."""
        width = self.spark._jsparkSession.parseDataType(self.schema.json()).defaultSize()
        return max(1, -(-size.bytes // FILE_BYTES), -(-max(size.rows * width, 4 * size.bytes) // SORT_BYTES))

    def append(self, df: DataFrame, blocks: BlockRange) -> Segment:
        """Commit rows of a range of blocks as one segment (an empty one too, so that its range counts as done)."""
        path, size, rows = self._write(df)
        now = time.time()
        segment = Segment(path, blocks, now, Size(blocks.end - blocks.start + 1, rows, size, 0, now))
        self._commit(lambda s: s | {"segments": [*s["segments"], self._json(segment)]})
        return segment

    def snapshot(self, canonical_only: bool = True, low: int | None = None, high: int | None = None) -> DataFrame:
        """The rows of one version of the table.  Files outside low..high are not opened; False shows forked blocks too."""
        chosen = [s for s in (self.canonical() if canonical_only else self.segments()) if s.size.bytes and (low is None or s.range.end >= low) and (high is None or s.range.start <= high)]
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.files.root}/{s.path}" for s in chosen))

    # Maintenance -----------------------------------------------------------------------

    def compact(self, limit: int = 2 << 30, by: str = "bytes", cooldown: float = 0.0) -> int:
        """Join runs of small canonical segments; the number of files written."""
        groups = compaction_groups(self.canonical(), limit, by, time.time(), cooldown)
        for group in groups:
            paths = [f"{self.files.root}/{s.path}" for s in group if s.size.bytes]
            df = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
            path, size, _ = self._write(df, self._parts(sum((s.size for s in group), Size())))
            now = time.time()
            made = joined(group, path, now)
            made = Segment(path, made.range, now, Size(made.size.blocks, made.size.rows, size, made.size.generation, made.size.created))
            gone = {s.path for s in group}
            self._commit(lambda s, gone=gone, made=made, now=now: {"segments": [d for d in s["segments"] if d["path"] not in gone] + [self._json(made)], "garbage": s["garbage"] + [{"path": p, "since": now} for p in sorted(gone)]})
        return len(groups)

    def collect_garbage(self, lock: float = 3600.0) -> int:
        """Delete replaced files that have been so for the lock time."""
        ripe = [g["path"] for g in self._state()[1]["garbage"] if time.time() - g["since"] >= lock]
        for p in ripe:
            self.files.delete(p)
        self._commit(lambda s: s | {"garbage": [g for g in s["garbage"] if g["path"] not in ripe]})
        return len(ripe)

    def check(self) -> dict[str, list[str]]:
        """Files that the manifest lacks, and files that it lists in vain."""
        there = {f"{self.revision}/data/{n}" for n, _, _ in self.files.list(f"{self.revision}/data")}
        state = self._state()[1]
        listed = {d["path"] for d in state["segments"] if d["size"]["bytes"]}
        known = listed | {g["path"] for g in state["garbage"]}
        return {"orphans": sorted(there - known), "missing": sorted(listed - there)}

    def restore(self, ranges: dict[str, BlockRange] | None = None, network: str = "main") -> int:
        """Rebuild a lost manifest from the revision's files: given ranges by file name, or the files' own block numbers."""
        found = []
        for name, _, modified in self.files.list(f"{self.revision}/data"):
            path = f"{self.revision}/data/{name}"
            size = self._bytes(path)
            own = self.spark.read.schema(self.schema).parquet(f"{self.files.root}/{path}").agg(F.min(BLOCK).alias("a"), F.max(BLOCK).alias("b"), F.count(F.lit(1)).alias("n")).first()
            if own["n"]:
                span = (ranges or {}).get(name) or BlockRange(own["a"], own["b"], network, str(own["b"]), str(own["a"] - 1))
                found.append(Segment(path, span, modified, Size(span.end - span.start + 1, own["n"], size, 0, modified)))
        self._commit(lambda s: {"segments": [self._json(x) for x in found], "garbage": []})
        return len(found)


def static_csv(spark: SparkSession, path: str, schema: T.StructType | str, has_header: bool = True) -> DataFrame:
    """A static table: CSV with a declared schema and no blocks."""
    return spark.read.schema(schema).option("header", has_header).option("mode", "FAILFAST").csv(path)


def scratch(spark: SparkSession, what: str) -> str:
    """A fresh folder that driver and executors share: below spark.checkpoint.dir, or for local masters without that setting a passing one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "blockloom-scratch")
    return f"{found.rstrip('/')}/{what}-{uuid.uuid4().hex}"
