"""Best-fit packing by patterns: a histogram problem, then a lookup.

Documents become pieces of at most ``capacity`` ids.  Which piece goes where
depends on lengths alone, so the packing is planned on the histogram of
lengths (at most ``capacity`` numbers, however many documents there are):

1. patterns: combinations of few lengths whose sum is the capacity or little less;
2. non-negative least squares fits how often each pattern repeats to the histogram;
3. the counts, or a share of them where that takes fewer sequences (``SHARES``),
   are rounded down and clipped to what is left of each length;
4. the residual lengths are packed best fit, longest first, with equal bins
   filled together.

The plan says, for each length, which sequences its first, second, ... piece
goes to, in intervals.  Pieces get their number among those of equal length by
counts over (length, bucket), so no length's pieces meet in one task.

Edge cases: a null or empty text is the end id alone; an empty table gives no
rows; repeated doc_ids are packed as the rows they are (but cannot be told
apart in the result); other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import blocks, checkpoint, table
from ._tokens import encoder

CAPACITY = 4096
END_ID = 1
#: Pieces of equal length are numbered in this many buckets.
BUCKETS = 1024
#: At most so many patterns enter the least-squares fit.
PATTERNS = 3000


def pieces(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for block in blocks(batches):
            ids, counts = encode(block, end_id)
            ends = np.cumsum(counts)
            n = -(-counts // capacity)
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(counts[row] - start, capacity)
            at = (ends - counts)[row] + start
            crcs = [zlib.crc32(ids[a:b].astype("<u4", copy=False)) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
            yield pa.record_batch([block.ids.take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def nnls(rows: np.ndarray, cols: np.ndarray, b: np.ndarray, n: int, rounds: int = 400) -> np.ndarray:
    """argmin |A x - b| over x >= 0, by accelerated projected gradients with restarts.  A has a one added at each (row, col)."""

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(rows, x[cols], len(b))

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(cols, r[rows], n)

    v = np.ones(n)
    for _ in range(30):  # the largest eigenvalue of A'A
        v = back(forward(v / max(np.linalg.norm(v), 1e-12)))
    step = 1.0 / max(1.05 * np.linalg.norm(v), 1e-12)
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(forward(y) - b))
        if (y - new) @ (new - x) > 0:
            t = 1.0
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def candidate_patterns(counts: np.ndarray, capacity: int, most: int = PATTERNS) -> list[tuple[int, ...]]:
    """Combinations of one to four present lengths that fill a sequence whole, or nearly; commoner lengths first."""
    present = np.flatnonzero(counts)
    have = np.zeros(capacity + 1, dtype=bool)
    have[present] = True
    # best[r]: the longest present length that is at most r
    best = np.maximum.accumulate(np.where(have, np.arange(capacity + 1), 0))
    common = present[np.argsort(-counts[present] * present, kind="stable")]
    found: dict[tuple[int, ...], None] = {}

    def close(parts: tuple[int, ...], slots: int) -> None:
        room = capacity - sum(parts)
        while slots and room and best[room]:
            parts += (int(best[room]),)
            room = capacity - sum(parts)
            slots -= 1
        if room <= capacity // 64:
            found.setdefault(tuple(sorted(parts, reverse=True)))

    for a in common:
        close((int(a),), 1)
        close((int(a),), 3)
        if len(found) >= most // 3:
            break
    for a in common[:80]:
        for b in common[:80]:
            if a + b <= capacity:
                close((int(a), int(b)), 1)
                close((int(a), int(b)), 2)
            if len(found) >= most:
                return list(found)
    return list(found)


#: Shares of the fitted repeats that are tried; the one of fewest sequences is taken.  Rounding weighs most where counts are small.
SHARES = (1.0, 0.75, 0.5, 0.25, 0.0)


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """(pattern, repeats) pairs that use up every length's count; and how many of them the fitted patterns gave."""
    left = counts.astype(np.int64).copy()
    whole = [((capacity,), int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    patterns = candidate_patterns(left, capacity)
    if not patterns:
        return whole + _best_fit(left, capacity), len(whole)
    present = np.flatnonzero(left)
    row = np.full(capacity + 1, -1)
    row[present] = np.arange(len(present))
    cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
    rows = row[np.concatenate([np.asarray(p) for p in patterns])]
    fitted = nnls(rows, cols, left[present].astype(float), len(patterns))
    best: tuple[int, list, int] | None = None
    for share in SHARES:
        taken, rest = _repeated(patterns, np.floor(share * fitted + 1e-3).astype(np.int64), left, capacity)
        made = taken + _best_fit(rest, capacity)
        n = sum(times for _, times in made)
        if best is None or n < best[0]:
            best = (n, made, len(taken))
    return whole + best[1], len(whole) + best[2]


def _repeated(patterns: list[tuple[int, ...]], repeats: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], np.ndarray]:
    """The patterns' repeats, clipped to what is there, and what they leave."""
    left, out = counts.copy(), []
    for j in np.argsort(-repeats, kind="stable"):
        if repeats[j] <= 0:
            break
        need = np.bincount(patterns[j], minlength=capacity + 1)
        used = np.flatnonzero(need)
        times = int(min(repeats[j], (left[used] // need[used]).min()))
        if times > 0:
            left[used] -= times * need[used]
            out.append((patterns[j], times))
    return out, left


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Lengths packed longest first into the fullest open bin with room; bins[r] holds contents with r ids of room."""
    bins: dict[int, dict[tuple[int, ...], int]] = {}
    rooms = np.zeros(capacity + 1, np.int64)
    for length in np.flatnonzero(left)[::-1]:
        length, n = int(length), int(left[length])
        while n:
            fits = np.flatnonzero(rooms[length:])
            room = length + int(fits[0]) if len(fits) else capacity
            if len(fits):
                parts, times = next(iter(bins[room].items()))
                take = min(n, times)
                if take == times:
                    del bins[room][parts]
                else:
                    bins[room][parts] = times - take
                rooms[room] -= take
            else:
                k = capacity // length
                parts, take = (length,) * (min(k, n) - 1), max(1, n // k)
                n -= take * (len(parts) + 1) - take
            new = parts + (length,)
            bins.setdefault(room := capacity - sum(new), {})
            bins[room][new] = bins[room].get(new, 0) + take
            rooms[room] += take
            n -= take
    return [(p, n) for group in bins.values() for p, n in group.items()]


class Places:
    """The plan by length: piece number i of a length goes to sequence(i) at offset(i)."""

    def __init__(self, chosen: list[tuple[tuple[int, ...], int]], capacity: int) -> None:
        lengths, firsts, bases, offsets = [], [], [], []
        used = np.zeros(capacity + 1, np.int64)
        base = 0
        for pattern, times in chosen:
            at = 0
            for length in pattern:
                lengths.append(length)
                firsts.append(used[length])
                bases.append(base)
                offsets.append(at)
                used[length] += times
                at += length
            base += times
        order = np.lexsort([firsts, lengths]) if lengths else np.zeros(0, np.int64)
        self.first, self.base, self.offset = (np.asarray(x, np.int64)[order] for x in (firsts, bases, offsets))
        self.bounds = np.searchsorted(np.asarray(lengths, np.int64)[order], np.arange(capacity + 2))
        # One sorted key for all lengths: (length, first number).
        self.span = int(used.max(initial=0)) + 1
        self.key = np.asarray(lengths, np.int64)[order] * self.span + self.first
        self.n_sequences = base

    def __call__(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, length * self.span + number, side="right") - 1
        return self.base[i] + number - self.first[i], self.offset[i]


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, vocabulary: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Pieces with their sequence_id and offset."""
    spark = docs.sparkSession
    cut = checkpoint(pieces(docs, capacity, end_id, vocabulary).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int")))
    per = checkpoint(cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")))
    # At most `capacity` rows come back, whatever the number of documents.
    counts = np.zeros(capacity + 1, np.int64)
    for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    chosen, _ = plan(counts, capacity)
    places = spark.sparkContext.broadcast(Places(chosen, capacity))
    before = per.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("length", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    numbered = cut.withColumn("nth", nth).join(before, ["length", "bucket"]).withColumn("number", F.col("nth") + F.col("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value(batch["length"].to_numpy(), batch["number"].to_numpy())
            yield pa.record_batch([*(batch[n] for n in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return numbered.select(*names, "number").mapInArrow(put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op5_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
