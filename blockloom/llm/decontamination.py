"""Benchmark decontamination by an FM-index for each training shard.

A shard is one block of documents, read as the sequence of its words.  Words
that no benchmark item has, and the bounds of documents, are separators; runs
of benchmark words shorter than the shortest window cannot hold one and are
left out.  Over what remains stand

* the suffix order, by prefix doubling (each separator sorts as its own symbol),
* the Burrows-Wheeler transform in a wavelet matrix, whose per-level counts give ranks,
* every ``SAMPLE``-th text position of the suffix order.

All windows of all items search backwards at once, one symbol a step; hits are
located by walking back to a sampled position, then confirmed against the bytes
of the words themselves, and their spans are merged per document.

A window is 8 consecutive words of an item; an item of fewer words, but not
none, is one window.  Words are lower-cased (A-Z only) runs of digits, letters
and bytes from 0x80.

The items are read in blocks of at most ``BLOCK_WORDS`` windows (a longer item is
cut, its windows shared out).  One block is on the driver, broadcast and in a
worker at a time.  A benchmark of one block, the usual case, is searched for in
the pass that writes the result.  One of more blocks takes a pass for each: the
hits of a block, by a 128-bit digest of the text they are in, are written to the
shared folder, the block's broadcast is destroyed, and the hits of all blocks
meet their texts at the end.

Edge cases: a null or empty text has no words and is clean; repeated rows are
judged each by itself; an item id that comes twice counts once; null items have
no windows, null item ids no name, so they hit words but are in no list; empty
tables give no rows or no hits; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Block, SpanHash, blocks, fresh_dir, ragged, same_bytes, spans, table

WINDOW = 8
MIN_ITEMS = 2
SAMPLE = 4
BLOCK_WORDS = 200_000
SHARD_BYTES = 3 << 20

_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)


def words(buf: np.ndarray, offsets: np.ndarray, hasher: SpanHash) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words of lower-cased bytes."""
    starts, ends = spans(WORD[buf], offsets)
    return starts, ends, hasher(buf, starts, ends)


class Windows:
    """The distinct windows of some pieces of items: rows of symbols 1..V (0 pads in front), their lengths, and the items of each.

    A symbol is a word, by its bytes; should two words share a hash, their bytes tell their symbols.
    """

    def __init__(self, pieces: list[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        vocabulary = sorted({w for _, own in pieces for w in own})
        self.sizes = np.asarray([0, *map(len, vocabulary)], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(vocabulary), np.uint8)
        hashes = SpanHash()(self.bytes, self.starts[1:], self.starts[1:] + self.sizes[1:])
        self.symbol_of = np.argsort(hashes, kind="stable") + 1
        self.hashes = hashes[self.symbol_of - 1]
        twice = np.unique(self.hashes[1:][self.hashes[1:] == self.hashes[:-1]])
        self.ambiguous = {w: k + 1 for k, w in enumerate(vocabulary) if hashes[k] in twice}
        self.twice = twice
        number = {w: k + 1 for k, w in enumerate(vocabulary)}
        found: dict[tuple[int, ...], set[int]] = {}
        names = sorted({i for i, _ in pieces if i is not None})
        self.item_ids = names
        rank = {i: k for k, i in enumerate(names)}
        for item, own_words in pieces:
            own = [number[w] for w in own_words]
            for a in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[a : a + window]), set()).update(() if item is None else (rank[item],))
        self.lengths = np.asarray([len(w) for w in found], np.int64)
        self.symbols = np.zeros((len(found), window), np.int64)
        for i, w in enumerate(found):
            self.symbols[i, window - len(w) :] = w
        items = [sorted(x) for x in found.values()]
        self.n_items = np.asarray([len(x) for x in items], np.int64)
        self.flat_items = np.asarray([i for x in items for i in x], np.int64)
        self.first_item = np.cumsum(self.n_items) - self.n_items

    def __len__(self) -> int:
        return len(self.lengths)

    @property
    def n_symbols(self) -> int:
        return len(self.hashes)

    def encode(self, hashes: np.ndarray, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Symbols of words by hash; 0 for words that no item has."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64)
        i = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        out = np.where(self.hashes[i] == hashes, self.symbol_of[i], 0)
        for k in np.flatnonzero(np.isin(hashes, self.twice)) if len(self.twice) else ():
            out[k] = self.ambiguous.get(buf[starts[k] : ends[k]].tobytes(), 0)
        return out


def suffix_order(text: np.ndarray) -> np.ndarray:
    """The suffix array of symbols, each 0 being a separator of its own that sorts by place (prefix doubling)."""
    n = len(text)
    rank = text.astype(np.int64)
    zero = text == 0
    n_zero = int(zero.sum())
    rank += n_zero
    rank[zero] = np.arange(n_zero)
    order = np.argsort(rank, kind="stable")
    k = 1
    while True:
        same = np.concatenate([[False], rank[order][1:] == rank[order][:-1]])
        first = np.flatnonzero(~same)
        place = np.repeat(first, np.diff(np.concatenate([first, [n]])))
        rank = np.empty(n, np.int64)
        rank[order] = place
        open_ = np.flatnonzero(same | np.concatenate([same[1:], [False]]))
        if not len(open_):
            return order
        at = order[open_]
        after = np.where(at + k < n, rank[np.minimum(at + k, n - 1)] + 1, 0)
        order[open_] = at[np.lexsort([after, rank[at]])]
        # Refine: new ranks need both keys; give them through a combined value.
        key = rank * (n + 1)
        key[at] += after
        rank = key
        k *= 2


class WaveletMatrix:
    """Ranks of symbols in a sequence: per level the bits' counts, and how many zeros the level has."""

    def __init__(self, seq: np.ndarray, n_symbols: int) -> None:
        self.levels = max(1, int(n_symbols).bit_length())
        self.ones, self.zeros = [], []
        seq = seq.copy()
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(len(seq) - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the first `at` symbols are `symbol`."""
        lo, hi = np.zeros(len(at), np.int64), at.astype(np.int64)
        for i, level in enumerate(range(self.levels - 1, -1, -1)):
            ones, zeros = self.ones[i], self.zeros[i]
            bit = (symbol >> level) & 1
            a, b = ones[lo], ones[hi]
            lo = np.where(bit == 1, zeros + a, lo - a)
            hi = np.where(bit == 1, zeros + b, hi - b)
        return hi - lo


class FMIndex:
    """Backward search and location over one shard's symbols; 0 is a separator and never searched for."""

    def __init__(self, text: np.ndarray, n_symbols: int, sample: int = SAMPLE) -> None:
        order = suffix_order(text)
        self.n = len(text)
        self.bwt = text[order - 1]  # order 0 takes the last symbol, which is a separator
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        self.wavelet = WaveletMatrix(self.bwt, n_symbols)
        self.sampled = order % sample == 0
        # A separator's suffix cannot be walked back through a shared symbol, so what follows one is sampled as well.
        self.sampled |= self.bwt == 0
        self.nth = np.concatenate([[0], np.cumsum(self.sampled)])
        self.positions = order[self.sampled]

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern (right-aligned symbols) the bounds of its suffixes in the suffix order."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        for step in range(patterns.shape[1]):
            live = live[(lengths[live] > step) & (hi[live] > lo[live])]
            symbol = patterns[live, -1 - step]
            lo[live] = self.less[symbol] + self.wavelet.rank(symbol, lo[live])
            hi[live] = self.less[symbol] + self.wavelet.rank(symbol, hi[live])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes by their rows in the suffix order."""
        rows, steps = rows.copy(), np.zeros(len(rows), np.int64)
        live = np.flatnonzero(~self.sampled[rows])
        while len(live):
            symbol = self.bwt[rows[live]]
            rows[live] = self.less[symbol] + self.wavelet.rank(symbol, rows[live])
            steps[live] += 1
            live = live[~self.sampled[rows[live]]]
        return self.positions[self.nth[rows]] + steps


def hits(buf: np.ndarray, row: np.ndarray, windows: Windows, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences of windows among the words of lower-cased bytes: first word, and window number."""
    starts, ends, hashes = found
    none = np.zeros(0, np.int64)
    if not len(windows) or not len(starts):
        return none, none
    symbol = windows.encode(hashes, buf, starts, ends)
    bounds = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    a, b = spans(symbol > 0, np.concatenate([bounds, [len(symbol)]]))
    long_enough = b - a >= windows.lengths.min()
    a, b = a[long_enough], b[long_enough]
    if not len(a):
        return none, none
    # The shard: each run of symbols and a separator.
    sizes = b - a + 1
    ends_of_runs = np.cumsum(sizes)
    place = ragged(a, sizes)
    text = symbol[np.minimum(place, len(symbol) - 1)]
    text[ends_of_runs - 1] = 0
    index = FMIndex(text, windows.n_symbols)
    lo, hi = index.search(windows.symbols, windows.lengths)
    n = np.maximum(hi - lo, 0)
    window = np.repeat(np.arange(len(n)), n)
    at = place[index.locate(ragged(lo, n))]
    # Exact check: the words of each distinct place in an occurrence have the bytes of their symbols.
    touched = np.zeros(len(starts), dtype=bool)
    touched[ragged(at, windows.lengths[window])] = True
    own = np.flatnonzero(touched)
    wanted = symbol[own]
    size = ends[own] - starts[own]
    right = size == windows.sizes[wanted]
    right[right] = same_bytes(buf, starts[own[right]], windows.bytes, windows.starts[wanted[right]], size[right])
    if not right.all():
        wrong = np.zeros(len(starts) + 1, np.int64)
        wrong[own[~right] + 1] = 1
        wrong = np.cumsum(wrong)
        keep = wrong[at + windows.lengths[window]] == wrong[at]
        at, window = at[keep], window[keep]
    return at, window


def _pieces(benchmark: DataFrame, window: int, block_words: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """The items' words in blocks of at most block_words windows, read one after another."""
    block, size = [], 0
    items = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).filter("t is not null").distinct()
    for item in items.orderBy("i", "t").toLocalIterator():
        buf = LOWER[np.frombuffer(item["t"].encode(), np.uint8)]
        starts, ends = spans(WORD[buf], np.asarray([0, len(buf)]))
        own = [buf[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        at = 0
        while at < max(1, len(own) - window + 1) and own:
            if size >= block_words:
                yield block
                block, size = [], 0
            n = min(block_words - size, max(1, len(own) - window + 1) - at)
            block.append((item["i"], own[at : at + n + window - 1]))
            at, size = at + n, size + n
    if block:
        yield block


class Shard:
    """The words of a block of documents, and the hits found in it."""

    def __init__(self, block: Block, hasher: SpanHash) -> None:
        self.block, self.buf = block, LOWER[block.buf]
        self.found = words(self.buf, block.offsets, hasher)
        self.row = block.rows_of(self.found[0])
        self.depth = np.zeros(len(self.row) + 1, np.int64)
        self.items: list[set[str]] = [set() for _ in range(len(block))]

    def search(self, windows: Windows) -> None:
        at, which = hits(self.buf, self.row, windows, self.found)
        self.cover(at, at + windows.lengths[which])
        each = ragged(windows.first_item[which], windows.n_items[which])
        n = max(len(windows.item_ids), 1)
        pairs = np.unique(np.repeat(self.row[at], windows.n_items[which]) * n + windows.flat_items[each])
        for r, i in zip((pairs // n).tolist(), (pairs % n).tolist(), strict=True):
            self.items[r].add(windows.item_ids[i])

    def cover(self, first: np.ndarray, end: np.ndarray) -> None:
        """Words first .. end - 1 (numbers in the block) are hit."""
        self.depth += np.bincount(first, minlength=len(self.depth)) - np.bincount(end, minlength=len(self.depth))

    @property
    def hit(self) -> np.ndarray:
        return np.cumsum(self.depth[:-1]) > 0

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of hit words: row, first and end word."""
        bounds = np.flatnonzero(np.append(True, self.row[1:] != self.row[:-1])) if len(self.row) else np.zeros(0, np.int64)
        a, b = spans(self.hit, np.append(bounds, len(self.row)))
        return self.row[a], a, b

    def byte_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs as row, first and end byte in the row."""
        of, a, b = self.runs()
        return of, self.found[0][a] - self.block.offsets[of], self.found[1][b - 1] - self.block.offsets[of]


_DIGEST = ["_op10_a", "_op10_b"]


def _digested(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.withColumns({_DIGEST[0]: F.xxhash64(text), _DIGEST[1]: F.xxhash64(F.lit(1), text)})


def _hits_of(docs: DataFrame, block: list, window: int) -> DataFrame:
    """Written to the shared folder: for each text with hits of a block of windows its digest, hit runs (first and end word in the text) and item ids."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Windows(block, window))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for block in blocks(batches, key=_DIGEST[0], limit=SHARD_BYTES):
            shard = Shard(block, hasher)
            shard.search(shared.value)
            of, a, b = shard.runs()
            first = np.searchsorted(shard.row, of)
            rows = np.unique(of)
            runs = [[[int(x), int(y)] for x, y in zip((a - first)[of == r], (b - first)[of == r], strict=True)] for r in rows]
            digest = [block.batch[c].take(pa.array(rows)) for c in _DIGEST]
            yield pa.record_batch([*digest, pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array([sorted(shard.items[r]) for r in rows], pa.list_(pa.string()))], names=[*_DIGEST, "runs", "items"])

    path = fresh_dir(spark, "op10-hits")
    texts = _digested(docs.select("text")).select(F.col("text").cast("string").alias("text"), *_DIGEST)
    texts.mapInArrow(search, f"{_DIGEST[0]} long, {_DIGEST[1]} long, runs array<array<long>>, items array<string>").dropDuplicates(_DIGEST).write.parquet(path)
    shared.destroy()
    return spark.read.parquet(path)


def _searched(docs: DataFrame, benchmark: DataFrame, window: int, block_words: int, finish, schema) -> DataFrame:
    """finish(shard, its rows' batch) of every block of documents, after all windows have been searched for in it."""
    spark = docs.sparkSession
    made = _pieces(benchmark, window, block_words)
    first, second = next(made, []), next(made, None)
    if second is None:
        shared = spark.sparkContext.broadcast(Windows(first, window))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = SpanHash()
            for block in blocks(batches, limit=SHARD_BYTES):
                shard = Shard(block, hasher)
                shard.search(shared.value)
                yield finish(shard)

        return docs.mapInArrow(scan, schema)
    parts = [_hits_of(docs, b, window) for b in (first, second)] + [_hits_of(docs, b, window) for b in made]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    # The hits of one text: bounded by its words and the items.
    per = every.groupBy(*_DIGEST).agg(F.flatten(F.collect_list("runs")).alias("_op10_runs"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("_op10_items"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for block in blocks(batches, limit=SHARD_BYTES):
            shard = Shard(block, hasher)
            first = np.searchsorted(shard.row, np.arange(len(block)))
            for r, (runs, items) in enumerate(zip(block.batch["_op10_runs"].to_pylist(), block.batch["_op10_items"].to_pylist(), strict=True)):
                if runs:
                    x = np.asarray(runs, np.int64) + first[r]
                    shard.cover(x[:, 0], x[:, 1])
                    shard.items[r].update(items)
            yield finish(shard)

    return _digested(docs).join(per, _DIGEST, "left").mapInArrow(merge, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_items: int = MIN_ITEMS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, and the merged removal spans in bytes."""

    def finish(shard: Shard) -> pa.RecordBatch:
        n = len(shard.block)
        of, a, b = shard.byte_spans()
        pairs = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * len(a) + 1, 2), pa.int32()), pa.array(np.stack([a, b], 1).reshape(-1)))
        span_lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(np.bincount(of, minlength=n))), pa.int32()), pairs)
        n_items = np.asarray([len(m) for m in shard.items], np.int64)
        shas = [hashlib.sha256(",".join(sorted(m)).encode()).hexdigest() for m in shard.items]
        counts = [np.bincount(shard.row, minlength=n), np.bincount(shard.row[shard.hit], minlength=n)]
        return pa.record_batch([shard.block.ids, *map(pa.array, counts), pa.array(n_items), pa.array(shas), pa.array(n_items >= min_items), span_lists], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _searched(texts, benchmark, window, block_words, finish, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<array<long>>")


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with the spans of benchmark windows cut from the texts, and n_chars, if there is one, following the text; other columns pass."""
    names = docs.columns

    def finish(shard: Shard) -> pa.RecordBatch:
        block = shard.block
        of, a, b = shard.byte_spans()
        texts: list[str | None] = block.batch["text"].to_pylist()
        for r in np.unique(of).tolist():
            keep = np.ones(block.offsets[r + 1] - block.offsets[r], dtype=bool)
            for x, y in zip(a[of == r].tolist(), b[of == r].tolist(), strict=True):
                keep[x:y] = False
            texts[r] = block.buf[block.offsets[r] : block.offsets[r + 1]][keep].tobytes().decode()
        changed = {"text": pa.array(texts, pa.string())}
        if len(of) and "n_chars" in names:
            chars = block.batch["n_chars"].to_pylist()
            for r in np.unique(of).tolist():
                chars[r] = len(texts[r])
            changed["n_chars"] = pa.array(chars, block.batch["n_chars"].type)
        return pa.record_batch([changed.get(c, block.batch[c]) for c in names], names=names)

    return _searched(docs, benchmark, window, block_words, finish, docs.schema)


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
