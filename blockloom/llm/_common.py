"""Helpers that the training-data operators share.

Rows reach Python as Arrow batches.  ``blocks`` hands them on as flat UTF-8
buffers (``Block``), cut so that one block holds a bounded number of bytes; a
single longer text is never cut and makes a block of its own.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

BLOCK_BYTES = 2 << 20

# Fixed odd constants of the hashes; any odd values would do.
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
#: Moduli and bases of the span hashes: two primes below 2**31, so that products stay below 2**62.
_MODULI = ((2**31 - 1, 1_299_709_357), (2**31 - 19, 1_618_033_988))
#: Powers are kept for so many places; longer spans are summed piece by piece.
SEGMENT = 1 << 16


#: Arrow batches that go to Python hold so many bytes at most (one longer row makes a batch of its own).
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the session by bytes, not only by rows: rows are whole texts here, of any length."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset (local tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = os.path.join(tempfile.gettempdir(), "blockloom-checkpoints")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Spark removes an execution's shuffle files at its end if this is set; else they stay until the driver collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpoint(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage, in the shared folder.  The shuffle files that it took go at once: nothing reads them again."""
    spark = df.sparkSession
    shared_dir(spark)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        # A frame takes the setting when it is made.
        return df.select("*").checkpoint()
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def fresh_dir(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@dataclass
class Block:
    """Some rows' texts: row i has the bytes buf[offsets[i]:offsets[i + 1]]; null texts are empty."""

    ids: pa.Array
    buf: np.ndarray
    offsets: np.ndarray
    null: np.ndarray
    batch: pa.RecordBatch

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.buf[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def rows_of(self, at: np.ndarray) -> np.ndarray:
        """The rows that the byte positions lie in."""
        return np.searchsorted(self.offsets, at, side="right") - 1

    def per_row(self, mask: np.ndarray) -> np.ndarray:
        """How many bytes of each row the mask holds."""
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]


def release() -> None:
    """Give freed memory back to the system: workers live on between tasks, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def releasing(make):
    """Let a task's generator give its memory back when it ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from make(batches)
        finally:
            release()

    return run


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", key: str = "doc_id", limit: int = BLOCK_BYTES) -> Iterator[Block]:
    try:
        yield from _blocks(batches, text, key, limit)
    finally:
        release()


def _blocks(batches: Iterator[pa.RecordBatch], text: str, key: str, limit: int) -> Iterator[Block]:
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        ids = batch.column(batch.schema.get_field_index(key))
        null = np.asarray(column.is_null().to_numpy(zero_copy_only=False), dtype=bool)
        if null.any():
            column = column.fill_null("")
        _, ends, data = column.buffers()
        at = np.frombuffer(ends, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        first = 0
        while first < len(column):
            last = max(first + 1, int(np.searchsorted(at, at[first] + limit, side="right")) - 1)
            last = min(last, len(column))
            yield Block(ids[first:last], raw[at[first] : at[last]], at[first : last + 1] - at[first], null[first:last], batch.slice(first, last - first))
            first = last


def spans(member: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a row's bound."""
    n = len(member)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = member[:-1]
    starts = np.flatnonzero(member & (~before | edge[:-1]))
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = member[1:]
    ends = np.flatnonzero(member & (~after | edge[1:])) + 1
    return starts, ends


def _rest(x: np.ndarray, prime: np.uint64) -> np.ndarray:
    """x modulo prime; dividing by a scalar is vectorised, the remainder is not."""
    return x - x // prime * prime


def _powers(base: int, prime: int) -> np.ndarray:
    out, size = np.ones(SEGMENT, np.uint64), 1
    while size < SEGMENT:
        out[size : 2 * size] = _rest(out[:size] * np.uint64(pow(base, size, prime)), np.uint64(prime))
        size *= 2
    return out


class SpanHash:
    """62-bit hashes of byte spans: polynomials modulo two primes, each from one running sum, so that all spans of a block cost the same few passes.

    Different texts of n bytes share a hash with a chance of about (n / 2**31)**2 at
    most; modulo a power of two some families of texts (Thue-Morse ones) would
    always.  Where a result must be exact, bytes are compared as well (``span_ids``).
    """

    def __init__(self) -> None:
        self.tables = [(np.uint64(p), _powers(b, p), _powers(pow(b, -1, p), p), np.uint64(pow(b, SEGMENT, p))) for p, b in _MODULI]

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(buf)
        values = np.zeros((-(-n // SEGMENT), SEGMENT), np.uint64)
        values.reshape(-1)[:n] = buf
        values += np.uint64(1)
        place = starts % SEGMENT
        first = np.minimum(ends, starts - place + SEGMENT)
        out = np.zeros(len(starts), np.uint64)
        for prime, power, inverse, step in self.tables:
            sums = np.zeros(n + 1, np.uint64)  # may wrap: a piece's own sum is below 2**56
            np.cumsum((values * power).reshape(-1)[:n], out=sums[1:])
            factor = inverse[place]
            total = _rest(_rest(sums[first] - sums[starts], prime) * factor, prime)
            at, more = first, np.flatnonzero(first < ends)
            while len(more):
                at = at.copy()
                factor[more] = _rest(factor[more] * step, prime)
                to = np.minimum(ends[more], at[more] + SEGMENT)
                total[more] = _rest(total[more] + _rest(sums[to] - sums[at[more]], prime) * factor[more], prime)
                at[more] = to
                more = more[to < ends[more]]
            out = (out << np.uint64(31)) | total
        return mix(out)


def same_bytes(a: np.ndarray, a_starts: np.ndarray, b: np.ndarray, b_starts: np.ndarray, lengths: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Whether the bytes of a from a_starts[i] are those of b from b_starts[i], lengths[i] each; some step bytes at a time."""
    out = np.ones(len(lengths), dtype=bool)
    sums = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        to = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + step, side="right")))
        x, y, n = a_starts[at:to], b_starts[at:to], lengths[at:to]
        if to == at + 1:
            out[at] = np.array_equal(a[x[0] : x[0] + n[0]], b[y[0] : y[0] + n[0]])
        else:
            differ = a[ragged(x, n)] != b[ragged(y, n)]
            out[at:to][np.repeat(np.arange(to - at), n)[differ]] = False
        at = to
    return out


def span_ids(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, hasher: SpanHash) -> np.ndarray:
    """A number for each span, from 0 on; equal numbers for equal bytes only: hashes propose, bytes decide."""
    _, first, ids = np.unique(hasher(buf, starts, ends), return_index=True, return_inverse=True)
    lead, lengths = first[ids], ends - starts
    other = np.flatnonzero(lead != np.arange(len(lead)))
    of = lead[other]
    if (lengths[other] == lengths[of]).all() and same_bytes(buf, starts[other], buf, starts[of], lengths[other]).all():
        return ids
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(buf[a:b].tobytes(), len(number)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.int64, len(starts))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] .. starts[i] + lengths[i] - 1, one run after another."""
    lengths = np.asarray(lengths, dtype=np.int64)
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(np.asarray(starts, dtype=np.int64) - (ends - lengths), lengths)


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(values, kind))


#: The most bytes of text that a training sample has.
SAMPLE_BYTES = 64 << 20


def bounded_sample(rows: DataFrame, label: str, most: int, per_label: int) -> DataFrame:
    """Distinct doc_ids by label: of each label the per_label first by a hash of doc_id, and at most ``most`` in all.

    The ranking runs on (label, doc_id) alone, each pair once, and within tasks
    first, so a common label's rows do not meet.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    spark = rows.sparkSession
    n = rows.select(label).distinct().limit(most + 1).count()
    keep = max(1, min(per_label, most // max(n, 1)))
    hashed = rows.select(label, "doc_id").distinct().withColumn("_h", F.xxhash64("doc_id", F.lit(7)))
    inner = Window.partitionBy(label, F.pmod("_h", F.lit(64))).orderBy("_h", "doc_id")
    outer = Window.partitionBy(label).orderBy("_h", "doc_id")
    some = hashed.withColumn("_r", F.row_number().over(inner)).filter(F.col("_r") <= keep)
    some = some.withColumn("_r", F.row_number().over(outer)).filter(F.col("_r") <= keep).limit(most)
    return spark.createDataFrame(sorted({r["doc_id"] for r in some.select("doc_id").collect()}), "long").toDF("doc_id") if n else some.select("doc_id")


def sampled_rows(rows: DataFrame, ids: DataFrame) -> list[dict]:
    """The rows (doc_id, text, ...) of a sample's ids on the driver: one of each doc_id, the shortest, and at most SAMPLE_BYTES of text.

    Shorter texts come first, so that a very long one displaces no other.  Lengths
    and hashes, a row an id, say which texts to fetch before any is.
    """
    from pyspark.sql import functions as F

    spark, others = rows.sparkSession, [c for c in rows.columns if c not in ("doc_id", "text")]
    named = rows.withColumns({"_n": F.octet_length("text"), "_h": F.xxhash64("text")})
    sizes = named.select("doc_id", "_n", "_h").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min(F.struct("_n", "_h")).alias("s")).select("doc_id", "s.*").collect()
    chosen, left = [], SAMPLE_BYTES
    for r in sorted(sizes, key=lambda r: (r["_n"], r["doc_id"])):
        left -= r["_n"]
        if left < 0:
            break
        chosen.append((r["doc_id"], r["_h"]))
    wanted = spark.createDataFrame(chosen, "doc_id long, _h long")
    one = named.join(F.broadcast(wanted), ["doc_id", "_h"]).groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("_row"))
    return one.select("doc_id", "_row.*").toArrow().to_pylist()


def skew_join(rows: DataFrame, per: DataFrame, keys: list[str]) -> DataFrame:
    """The rows joined to the one row that per has of each key, some keys having very many rows.

    Spark splits a hot key's rows over tasks if both sides come straight from an
    exchange.  The sides of an aggregate over the rows and a join with them share
    one, which rules that out; so the keys of per are made anew here.
    """
    from pyspark.sql import functions as F

    return rows.join(per.withColumns({k: F.col(k).bitwiseXOR(F.lit(0)) for k in keys}), keys)


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the least node of each component.

    Large-star and small-star contraction in turn (Kiveris et al., "Connected
    components in MapReduce and beyond"), each round checkpointed, until no
    edge changes.  Work a round is in proportion to the edges; the edges of one
    node are dealt over many tasks (``skew_join``).
    """
    from pyspark.sql import functions as F

    def star(links: DataFrame) -> DataFrame:
        return skew_join(links, links.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), ["a"])

    def total(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("b", "a") % 1000003)).first())

    edges = checkpoint(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = total(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = star(large).select("a", "b", "m")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        edges = checkpoint(small.filter("a <> b").distinct())
        now = total(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
