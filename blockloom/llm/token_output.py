"""Token-ID output: Arrow IPC files of equal-length sequences and masks.

``write`` puts the ids of all documents, in ascending doc_id order, into shard
files.  A shard holds the ids of one range of doc_id as rows of two
fixed-size lists, ``ids`` and ``mask`` (the last row is padded, its mask says
where).  Equal-length rows make ids one flat buffer per batch, so any row is
reached by arithmetic and without a copy.  Beside it lies a small index file:
doc_id, the document's place among the shard's ids, and its number of ids.

A task writes under a name of its own and renames when whole, so a lost
executor leaves no half file under a final name.

Shards are ranges of (doc_id, hash of the text), as many as the input's bytes ask
for (``SHARD_BYTES``), so that a shard and its index are bounded.

Edge cases: a null or empty text is only the end id; texts of one doc_id come in
the order of their hash and may lie in several shards; a null doc_id comes
first; an empty table gives no shards; other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.ipc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, fresh_dir, ragged
from ._tokens import encoder

SEQUENCE = 2048
ROWS_A_BATCH = 512
END_ID = 2
#: A shard has about so many bytes of text; Parquet's are taken to be a quarter of them.
SHARD_BYTES = 256 << 20
MANIFEST = "path string, first_id long, n_docs long, n_tokens long"


def _open(path: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pa.fs.FileSystem.from_uri(path)
    return pa.fs.LocalFileSystem(), path


class _Shard:
    """One shard file and its index while they are being written."""

    def __init__(self, folder: str, sequence: int, kind: pa.DataType) -> None:
        self.fs, root = _open(folder)
        self.fs.create_dir(root, recursive=True)
        self.final = f"{folder}/shard-{uuid.uuid4().hex}"
        self.path = f"{root}/{self.final.rsplit('/', 1)[1]}"
        self.sequence, self.kind = sequence, kind
        self.schema = pa.schema({"ids": pa.list_(kind, sequence), "mask": pa.list_(pa.bool_(), sequence)})
        self.out = self.fs.open_output_stream(f"{self.path}.part")
        self.writer = pa.ipc.new_file(self.out, self.schema)
        self.left = np.zeros(0, np.uint32)
        self.docs: list[tuple[pa.Array, np.ndarray]] = []
        self.total = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        self.docs.append((doc_ids, counts))
        self.total += len(ids)
        ids = np.concatenate([self.left, ids])
        step = self.sequence * ROWS_A_BATCH
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self._rows(ids[at : at + step])
        self.left = ids[whole:]

    def _rows(self, ids: np.ndarray) -> None:
        pad = -len(ids) % self.sequence
        mask = np.concatenate([np.ones(len(ids), bool), np.zeros(pad, bool)])
        ids = np.concatenate([ids, np.zeros(pad, ids.dtype)])
        flat = [pa.array(ids.astype(self.kind.to_pandas_dtype())), pa.array(mask)]
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(x, self.sequence) for x in flat], schema=self.schema))

    def close(self) -> dict:
        if len(self.left):
            self._rows(self.left)
        self.writer.close()
        self.out.close()
        ids = pa.concat_arrays([x for x, _ in self.docs])
        counts = np.concatenate([x for _, x in self.docs])
        index = pa.table({"doc_id": ids, "start": np.cumsum(counts) - counts, "n_tokens": counts})
        with self.fs.open_output_stream(f"{self.path}.index.part") as out, pa.ipc.new_file(out, index.schema) as writer:
            writer.write_table(index)
        self.fs.move(f"{self.path}.index.part", f"{self.path}.index.arrow")
        self.fs.move(f"{self.path}.part", f"{self.path}.arrow")
        return {"path": [self.final], "first_id": ids[:1], "n_docs": [len(ids)], "n_tokens": [self.total]}


def write(docs: DataFrame, folder: str, end_id: int = END_ID, sequence: int = SEQUENCE, vocabulary: str | None = None, shards: int | None = None) -> DataFrame:
    """Write the shards; returns their manifest in doc_id order: path, first_id, n_docs, n_tokens, and start (ids before the shard).

    The manifest has one row a shard, so ordering it over one partition is bounded by the number of files.
    """
    spark = docs.sparkSession
    stored = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    known = stored < 1 << 50  # rows of no files count as endless
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * stored // SHARD_BYTES if known else 0)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        kind = pa.uint16() if encode.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else pa.uint32()
        out = None
        for block in blocks(batches):
            out = out or _Shard(folder, sequence, kind)
            out.add(block.ids, *encode(block, end_id))
        if out:
            got = out.close()
            yield pa.record_batch([TaskContext.get().partitionId() * np.ones(1, np.int64), *map(pa.array, got.values())], names=["shard", *got])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = texts.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    return _placed(spark, ordered.mapInArrow(shard, f"shard long, {MANIFEST}"))


def _placed(spark, made: DataFrame) -> DataFrame:
    """Run the writing once; a row a file comes to the driver, where the files' starts are summed."""
    rows = sorted(made.collect(), key=lambda r: r["shard"])
    start, placed = 0, []
    for r in rows:
        placed.append((r["path"], r["first_id"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    return spark.createDataFrame(placed, f"{MANIFEST}, start long")


def read_rows(path: str, rows: range, mmap: bool = True) -> pa.Table:
    """Some rows of a shard by number; on a local file nothing but those rows' pages is touched."""
    fs, at = _open(f"{path}.arrow")
    source = pa.memory_map(at) if mmap and isinstance(fs, pa.fs.LocalFileSystem) else fs.open_input_file(at)
    reader = pa.ipc.open_file(source)
    parts = [reader.get_batch(i).slice(max(rows.start - i * ROWS_A_BATCH, 0), min(rows.stop - i * ROWS_A_BATCH, ROWS_A_BATCH) - max(rows.start - i * ROWS_A_BATCH, 0)) for i in range(rows.start // ROWS_A_BATCH, -(-rows.stop // ROWS_A_BATCH))]
    return pa.Table.from_batches(parts, reader.schema)


def read_back(manifest: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def per_doc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, at = _open(f"{row['path']}.index.arrow")
                index = pa.ipc.open_file(fs.open_input_file(at)).read_all()
                starts, counts = index["start"].to_numpy(), index["n_tokens"].to_numpy()
                for a in range(0, len(starts), 4096):
                    some, n = starts[a : a + 4096], counts[a : a + 4096]
                    first, last = int(some[0]) // sequence, -(-int(some[-1] + n[-1]) // sequence)
                    rows = read_rows(row["path"], range(first, last))
                    ids = np.concatenate([c.flatten().to_numpy(zero_copy_only=True) for c in rows["ids"].chunks])
                    mask = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in rows["mask"].chunks])
                    begin = some - first * sequence
                    if not mask[ragged(begin[-1:], n[-1:])].all():
                        raise ValueError(f"{row['path']}: a document lies in padding")
                    crcs = [zlib.crc32(ids[b : b + k].astype("<u4")) for b, k in zip(begin.tolist(), n.tolist(), strict=True)]
                    yield pa.record_batch([index["doc_id"].combine_chunks()[a : a + 4096], pa.array(some + row["start"]), pa.array(n), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = max(1, min(manifest.count(), 4096))
    return manifest.select("path", "start").repartition(n).mapInArrow(per_doc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_output(spark, sf_dir: str) -> DataFrame:
    from ._common import table

    folder = fresh_dir(spark, "tokens")
    return read_back(write(table(spark, sf_dir, "documents"), folder))
