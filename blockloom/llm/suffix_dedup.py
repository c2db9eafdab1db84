"""Removal of repeated 100-byte strings by column-wise construction of multi-string suffix orders.

A byte goes if a string of ``length`` bytes that covers it also starts earlier:
in a document of smaller doc_id, or earlier in the same document.

1. Anchors.  Each window of ``length`` bytes names the 32-byte string in it with
   the least hash (leftmost of equals).  Equal windows name equal anchors at
   equal places, so windows can only repeat among the chunks of one anchor: the
   runs of windows that name the same place.  A chunk has at most 69 windows
   and 168 bytes.
2. Chunks whose anchor comes once in the corpus are done.  Of the others, equal
   chunks are pre-aggregated to their first place; all later ones are repeats.
   Chunks count as equal if their anchors' and their own hashes (64 and 62 bits,
   of independent kinds) are: no bytes travel for them.  Different chunks of one
   anchor would share the latter with a chance below 2**-46 a pair.
3. The different chunks are dealt by anchor into collections.  A collection's
   Burrows-Wheeler transform is built column by column: every round inserts one
   symbol of every chunk, from the right, and updates transform and common
   prefixes (``extend``; after Bauer, Cox, Rosone and Sciortino, "Lightweight
   LCP construction for very large collections of strings").  The columns of a
   collection over ``SPILL_BYTES`` lie in sequential files that each round
   reads and rewrites once.
4. Runs of suffixes with ``length`` or more bytes in common are the repeated
   windows; all but the first place of a run are repeats.
5. A document's repeats are merged, cut out, and what is left is hashed.

An anchor with more than ``HOT`` different chunks is not gathered: its chunks are
cut into single windows that are dealt by their own hash, equal ones combined
within each task, and go through the same construction.

Edge cases: a null text is empty; a text under ``length`` bytes keeps everything;
repeated rows (same doc_id and text) are one document that comes out as often
as it came in; different texts under one doc_id are ordered by a 64-bit hash of
the text; rows without doc_id sort first, told apart by 126 bits of hashes of
the text; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SpanHash, blocks, checkpoint, mix, ragged, releasing, table

LENGTH = 100
ANCHOR = 32
HOT = 20_000
#: Chunks of a collection, and rows that a task combines before it sends them on.
COLLECTION = 1_500
COMBINE = 250_000
BLOCK_BYTES = 2 << 20
SPILL_BYTES = 256 << 20
_PLACE_BITS = np.uint64(22)
#: Rows without doc_id get numbers from here on, by a hash of their text.
_NO_ID = -(1 << 63)
# Fixed odd constants; any odd values would do.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)

#: A chunk's place and names, as it is sent: anchor hash, chunk hash, document, text hash, first window, windows.
PLACE = np.dtype([("anchor", "<u8"), ("chunk", "<u8"), ("doc", "<i8"), ("text", "<i8"), ("start", "<u4"), ("n", "u1")])


class AnchorHash:
    """64-bit names of the strings of one width at every byte, from one running sum.  Strings that share a name only share an anchor."""

    def __init__(self, width: int = ANCHOR) -> None:
        self.width = width
        self.power = self.inverse = np.ones(1, np.uint64)

    def __call__(self, buf: np.ndarray) -> np.ndarray:
        if len(self.power) <= len(buf):
            n = max(len(buf) + 1, 1 << 16)
            for name, base in (("power", _BASE), ("inverse", np.uint64(pow(int(_BASE), -1, 1 << 64)))):
                out = np.full(n, base, np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[buf] * self.power[: len(buf)], out=sums[1:])
        n = len(buf) - self.width + 1
        return mix((sums[self.width :] - sums[:n]) * self.inverse[:n])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values."""
    size, out = 1, values
    while 2 * size <= width:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    rest = width - size
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def chunks(buf: np.ndarray, offsets: np.ndarray, hasher: SpanHash, anchors: AnchorHash, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """The chunks of a block's rows: row, first window (byte of the block), number of windows, anchor hash, chunk hash."""
    none, anchor = np.zeros(0, np.int64), anchors.width
    if len(buf) < length:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    step = (1 << int(_PLACE_BITS)) - length
    rows, starts, counts, names, bodies = [], [], [], [], []
    for a in range(0, len(buf) - length + 1, step):
        part = buf[a : a + step + length - 1]
        hashes = anchors(part)
        packed = (hashes >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
        place = (sliding_least(packed, length - anchor + 1) & np.uint64((1 << int(_PLACE_BITS)) - 1)).astype(np.int64)
        n = len(place)
        own = offsets[(offsets > a) & (offsets < a + n + length)] - a
        valid = np.ones(n, dtype=bool)
        for k in own.tolist():
            valid[max(k - length + 1, 0) : k] = False
        edge = np.ones(n, dtype=bool)
        edge[1:] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
        edge[own[own < n]] = True
        first = np.flatnonzero(edge)
        count = np.diff(np.append(first, n))
        keep = valid[first]
        first, count = first[keep], count[keep]
        rows.append(np.searchsorted(offsets, first + a, side="right") - 1)
        starts.append(first + a)
        counts.append(count)
        names.append(hashes[place[first]])
        bodies.append(hasher(part, first, first + count + length - 1))
    return tuple(map(np.concatenate, (rows, starts, counts, names, bodies)))


def _sorted(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct places by anchor, chunk, document and start; and where a new (anchor, chunk) begins."""
    places = places[np.lexsort([places["start"], places["text"], places["doc"], places["chunk"], places["anchor"]])]
    new = np.ones(len(places), dtype=bool)
    new[1:] = (places["anchor"][1:] != places["anchor"][:-1]) | (places["chunk"][1:] != places["chunk"][:-1])
    other = new.copy()
    for f in ("doc", "text", "start"):
        other[1:] |= places[f][1:] != places[f][:-1]
    return places[other], new[other]


_SENT = "bucket int, known boolean, places binary"


def _send(places: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Packed rows: first places by their anchor's bucket; places already known as repeats by their document's."""
    if not len(places):
        return pa.record_batch([pa.array([], pa.int32()), pa.array([], pa.bool_()), pa.array([], pa.binary())], names=["bucket", "known", "places"])
    places, new = _sorted(places)
    where = np.where(new, places["anchor"] % np.uint64(buckets), mix(places["doc"].astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
    key = where * 2 + ~new
    order = np.argsort(key, kind="stable")
    key, places = key[order], places[order]
    cuts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    parts = [_pack(places[a:b]) for a, b in zip(cuts, np.append(cuts[1:], len(key)), strict=True)]
    return pa.record_batch([pa.array(key[cuts] // 2, pa.int32()), pa.array(key[cuts] % 2 == 1), pa.array(parts, pa.binary())], names=["bucket", "known", "places"])


def _pack(places: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(places[f]).tobytes() for f in PLACE.names)


def _unpack(data: bytes) -> np.ndarray:
    n = len(data) // PLACE.itemsize
    out, at = np.empty(n, PLACE), 0
    for f in PLACE.names:
        out[f] = np.frombuffer(data, PLACE[f], n, at)
        at += n * PLACE[f].itemsize
    return out


def _find_places(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, anchors = SpanHash(), AnchorHash()
        held: list[np.ndarray] = []
        n = 0
        for block in blocks(batches, limit=BLOCK_BYTES):
            row, start, count, name, body = chunks(block.buf, block.offsets, hasher, anchors, length)
            places = np.empty(len(row), PLACE)
            places["anchor"], places["chunk"], places["n"] = name, body, count
            places["doc"] = block.ids.to_numpy()[row]
            places["text"] = block.batch["text_hash"].to_numpy()[row]
            places["start"] = start - block.offsets[row]
            held.append(places)
            n += len(places)
            if n >= COMBINE:
                yield _send(np.concatenate(held), buckets)
                held, n = [], 0
        if held:
            yield _send(np.concatenate(held), buckets)

    return texts.mapInArrow(find, _SENT)


_FOUND = "doc_id long, text_hash long, anchor long, start int, n int, kind int"
REPEAT, CANDIDATE, WINDOWS = 0, 1, 2


def _found(places: np.ndarray, kind: int) -> pa.RecordBatch:
    anchor = np.ascontiguousarray(places["anchor"]).view(np.int64)
    columns = [places["doc"], places["text"], anchor, places["start"].astype(np.int32), places["n"].astype(np.int32), np.full(len(places), kind, np.int32)]
    return pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], names=["doc_id", "text_hash", "anchor", "start", "n", "kind"])


class _Bucket:
    """The places of some anchors as they come in, reduced whenever they have doubled."""

    def __init__(self, hot: int) -> None:
        self.hot, self.held, self.n, self.most = hot, [], 0, 2_000_000
        self.crowded = np.zeros(0, np.uint64)

    def add(self, places: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(places)
        self.n += len(places)
        if self.n > self.most:
            places = yield from self._reduce()
            self.held, self.n = [places], len(places)
            self.most = max(self.most, 2 * self.n)

    def _reduce(self) -> Iterator[pa.RecordBatch]:
        """Hand on later places of equal chunks (an earlier one is known, so they are repeats) and places of hot anchors; keep the rest."""
        places, new = _sorted(np.concatenate(self.held))
        yield _found(places[~new], REPEAT)
        places = places[new]
        anchors, times = np.unique(places["anchor"], return_counts=True)
        self.crowded = np.union1d(self.crowded, anchors[times > self.hot])
        apart = np.isin(places["anchor"], self.crowded)
        yield _found(places[apart], WINDOWS)
        return places[~apart]

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            places = yield from self._reduce()
            _, of, times = np.unique(places["anchor"], return_inverse=True, return_counts=True)
            # An anchor with one chunk, wherever it comes, has no different chunk to be compared with.
            yield _found(places[times[of] > 1], CANDIDATE)


def _meet(sent: DataFrame, hot: int) -> DataFrame:
    """Repeats among equal chunks; first places of the different chunks of an anchor; places of hot anchors."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number = _Bucket(hot), None
        for batch in batches:
            for b, known, data in zip(batch["bucket"].to_pylist(), batch["known"].to_pylist(), batch["places"], strict=True):
                places = _unpack(data.as_buffer())
                if known:
                    yield _found(places, REPEAT)
                    continue
                if b != number:
                    yield from bucket.close()
                    bucket, number = _Bucket(hot), b
                yield from bucket.add(places)
        yield from bucket.close()

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(releasing(meet), _FOUND)


def _column(n: int, kind: type) -> np.ndarray:
    """A column of a collection: in memory, or in an unnamed sequential file if it is large."""
    size = n * np.dtype(kind).itemsize
    if size <= SPILL_BYTES:
        return np.empty(n, kind)
    with tempfile.TemporaryFile() as file:
        return np.memmap(file, kind, "w+", shape=(n,))


def extend(buf: np.ndarray, ends: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffix order of a collection of strings, built by inserting one symbol of each string per round.

    String i is buf[ends[i] - sizes[i]:ends[i]]; bytes are below 255.  Returns for
    each suffix in order its string, its length, and its common prefix with the
    suffix before it.  Terminators sort by string and match nothing.

    The row of a suffix holds the symbol before it.  Sorting rows by (symbol,
    place), stably, is the LF-mapping; so where the rows written in the last
    round go says where the suffixes longer by one symbol are inserted.  A new
    suffix has one byte more in common with its neighbour than the least common
    prefix between their rows; that one interval minimum is all that is needed,
    for it and for the suffix after it.
    """
    m = len(sizes)
    symbol = np.where(sizes > 0, buf[np.maximum(ends - 1, 0)].astype(np.int16) + 1, 0).astype(np.uint8) if len(buf) else np.zeros(m, np.uint8)
    common = np.zeros(m, np.uint8)
    name = np.arange(m, dtype=np.uint64) << np.uint64(8)  # string, and in the low byte the suffix's length
    fresh = symbol > 0
    finished = int(np.count_nonzero(~fresh))
    for done in range(int(sizes.max(initial=0))):
        n = len(symbol)
        order = np.argsort(symbol, kind="stable")
        at = np.flatnonzero(fresh[order])  # places in the order by symbol of the rows to extend
        rows = order[at]
        new_symbols = symbol[rows]
        place = m + at - finished
        least = np.append(common, np.uint8(0))

        def shared(left: np.ndarray, right: np.ndarray, least: np.ndarray = least) -> np.ndarray:
            """One more than the least common prefix in (left, right]."""
            falling = np.argsort(-right)  # so that nothing between two intervals is read
            cuts = np.empty(2 * len(left), np.int64)
            cuts[0::2], cuts[1::2] = left[falling] + 1, right[falling] + 1
            out = np.empty(len(left), np.uint8)
            out[falling] = np.minimum.reduceat(least, cuts)[::2]
            return out + np.uint8(1)

        before = order[np.maximum(at - 1, 0)]
        has_before = (at > 0) & (symbol[before] == new_symbols)
        after = order[np.minimum(at + 1, n - 1)]
        has_after = (at + 1 < n) & (symbol[after] == new_symbols)
        grown = n + len(rows)
        old = np.ones(grown, dtype=bool)
        old[place] = False
        string = (name[rows] >> np.uint64(8)).astype(np.int64)
        more = sizes[string] > done + 1
        new_symbol = np.zeros(len(rows), np.uint8)
        new_symbol[more] = buf[ends[string[more]] - done - 2] + np.uint8(1)
        finished += len(rows) - int(np.count_nonzero(more))
        columns = []
        for column, value in ((symbol, new_symbol), (common, np.uint8(0)), (name, (string.astype(np.uint64) << np.uint64(8)) + np.uint64(done + 1))):
            wide = _column(grown, column.dtype.type)
            wide[old] = column
            wide[place] = value
            columns.append(wide)
        symbol, common, name = columns
        if has_after.any():
            common[place[has_after] + 1] = shared(rows[has_after], after[has_after])
        if has_before.any():
            common[place[has_before]] = shared(before[has_before], rows[has_before])
        fresh = ~old
        fresh[place[~more]] = False
    return (name >> np.uint64(8)).astype(np.int32), (name & np.uint64(255)).astype(np.uint8), common


def repeated_windows(data: list[bytes], places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which chunk, and which of its windows, repeat an earlier window of a collection; places[i] ranks chunk i's first window as (doc, text, start)."""
    sizes = np.asarray([len(d) for d in data], np.int64)
    string, size, common = extend(np.frombuffer(b"".join(data), np.uint8), np.cumsum(sizes), sizes)
    whole = size >= length
    joined = common[whole] >= length
    string = string[whole].astype(np.int64)
    window = sizes[string] - size[whole]
    run = np.cumsum(~joined)
    # Only runs of two or more matter.
    many = joined | np.append(joined[1:], False)
    string, window, run = string[many], window[many], run[many]
    start = places["start"][string] + window
    order = np.lexsort([start, places["text"][string], places["doc"][string], run])
    string, window, run, start = string[order], window[order], run[order], start[order]
    first = np.ones(len(run), dtype=bool)
    first[1:] = run[1:] != run[:-1]
    lead = np.flatnonzero(first)[np.cumsum(first) - 1] if len(run) else np.zeros(0, np.int64)
    later = (start != start[lead]) | (places["doc"][string] != places["doc"][string[lead]]) | (places["text"][string] != places["text"][string[lead]])
    return string[later], window[later]


_CHUNK = "collection int, key long, doc_id long, text_hash long, start int, n int, body binary"


def _fetch(texts: DataFrame, found: DataFrame, collections: int, length: int) -> DataFrame:
    """The bytes of chunks (or of single windows, where n is 1 and many may be equal); rows without bytes are known repeats."""
    wanted = found.filter(F.col("kind") > 0).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("anchor", "start", "n", "kind")).alias("places"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for block in blocks(batches):
            lists = block.batch["places"]
            flat = lists.flatten()
            anchor, start, n, kind = (flat.field(i).to_numpy() for i in range(4))
            row = np.repeat(np.arange(len(block)), lists.value_lengths().to_numpy())
            at = block.offsets[row] + start
            single = kind == WINDOWS
            # Hot anchors: one piece for each window, equal ones combined.
            each = ragged(at[single], n[single])
            each_row = np.repeat(row[single], n[single])
            key = hasher(block.buf, each, each + length)
            doc, text = block.ids.to_numpy(), block.batch["text_hash"].to_numpy()
            begin = each - block.offsets[each_row]
            order = np.lexsort([begin, text[each_row], doc[each_row], key])
            each, each_row, key, begin = each[order], each_row[order], key[order], begin[order]
            # A row that came in twice is one place.
            other = np.ones(len(key), dtype=bool)
            other[1:] = (key[1:] != key[:-1]) | (doc[each_row[1:]] != doc[each_row[:-1]]) | (text[each_row[1:]] != text[each_row[:-1]]) | (begin[1:] != begin[:-1])
            each, each_row, key = each[other], each_row[other], key[other]
            later = np.zeros(len(key), dtype=bool)
            later[1:] = key[1:] == key[:-1]
            row = np.concatenate([row[~single], each_row])
            at = np.concatenate([at[~single], each])
            n = np.concatenate([n[~single], np.ones(len(each), n.dtype)])
            key = np.concatenate([mix(anchor[~single].astype(np.uint64)), key])
            known = np.concatenate([np.zeros((~single).sum(), dtype=bool), later])
            raw = block.buf.tobytes()
            body = [None if k else raw[a : a + c + length - 1] for a, c, k in zip(at.tolist(), n.tolist(), known.tolist(), strict=True)]
            columns = [(key % np.uint64(collections)).astype(np.int32), key.view(np.int64), doc[row], text[row], (at - block.offsets[row]).astype(np.int32), n.astype(np.int32)]
            yield pa.record_batch([*map(pa.array, columns), pa.array(body, pa.binary())], names=["collection", "key", "doc_id", "text_hash", "start", "n", "body"])

    return texts.join(wanted, ["doc_id", "text_hash"]).mapInArrow(fetch, _CHUNK)


_RUN = "doc_id long, text_hash long, start int, n int"


def _construct(fetched: DataFrame, length: int) -> DataFrame:
    """The repeated windows of each collection, as runs; known repeats pass."""

    def construct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            got = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            places = np.empty(got.num_rows, [("doc", "<i8"), ("text", "<i8"), ("start", "<i8")])
            places["doc"], places["text"], places["start"] = (got[c].to_numpy() for c in ("doc_id", "text_hash", "start"))
            string, window = repeated_windows(got["body"].to_pylist(), places, length)
            order = np.lexsort([window, string])
            string, window = string[order], window[order]
            first = np.flatnonzero(np.append(True, (string[1:] != string[:-1]) | (window[1:] != window[:-1] + 1))) if len(string) else string
            n = np.diff(np.append(first, len(string)))
            own = places[string[first]]
            columns = [own["doc"], own["text"], (own["start"] + window[first]).astype(np.int32), n.astype(np.int32)]
            return pa.record_batch([pa.array(np.ascontiguousarray(c)) for c in columns], names=["doc_id", "text_hash", "start", "n"])

        for batch in batches:
            known = batch["body"].is_null()
            yield batch.filter(known).select(["doc_id", "text_hash", "start", "n"])
            batch = batch.filter(known.to_numpy(zero_copy_only=False) == False) if known.null_count or known.true_count else batch  # noqa: E712
            number = batch["collection"].to_numpy()
            cuts = np.flatnonzero(np.append(True, number[1:] != number[:-1])) if len(number) else []
            for a, b in zip(cuts, [*cuts[1:], len(number)], strict=True):
                if held and held[0]["collection"][0].as_py() != number[a]:
                    yield close()
                held.append(batch.slice(a, b - a))
        if held:
            yield close()

    return fetched.repartition("collection").sortWithinPartitions("collection").mapInArrow(releasing(construct), _RUN)


def _cut(texts: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """Per document the figures, the text that is left, and the row it came in (null unless carried)."""
    per = runs.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            lists = block.batch["runs"]
            flat = lists.flatten()
            start, n = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            row = np.repeat(np.arange(len(block)), lists.value_lengths().fill_null(0).to_numpy())
            at = block.offsets[row] + start
            depth = np.bincount(at, minlength=len(block.buf) + 1) - np.bincount(at + n + length - 1, minlength=len(block.buf) + 1)
            gone = np.cumsum(depth[:-1]) > 0
            edge = np.append(gone, False)
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            bounds = block.offsets[:-1][block.offsets[:-1] < len(block.buf)]
            begins[bounds] |= edge[bounds]
            left = [block.buf[a:b][~gone[a:b]].tobytes() for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True)]
            n_bytes = np.diff(block.offsets)
            # As text: what is left of a code point that lost a byte goes too.
            well_formed = [x.decode("utf-8", "ignore") for x in left] if carried else [None] * len(block)
            columns = [block.batch["id"], n_bytes, block.per_row(gone), block.per_row(begins), [hashlib.sha256(x).hexdigest() for x in left]]
            yield pa.record_batch([*map(pa.array, columns), pa.array(left, pa.binary()), pa.array(well_formed, pa.string()), block.batch["row"]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text", "row"])

    row = texts.schema["row"].dataType.simpleString()
    schema = f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, kept_text string, row {row}"
    carried = row != "int"
    return texts.join(per, ["doc_id", "text_hash"], "left").mapInArrow(cut, schema)


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, collection: int = COLLECTION, carry: list[str] | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes); with columns to carry, kept_text (the same as text) and row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    own = F.col("doc_id").cast("long")
    key = F.coalesce(own, F.lit(_NO_ID) + F.shiftrightunsigned(F.xxhash64(F.lit(1), text), 2))
    texts = docs.select(key.alias("doc_id"), own.alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"), (F.struct(*carry) if carry else F.lit(0)).alias("row"))
    # Input partitions hold a bounded number of bytes, so buckets in proportion to them hold a bounded number of places.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * texts.rdd.getNumPartitions())
    found = checkpoint(_meet(_find_places(texts, buckets, length), hot))
    n = found.filter(F.col("kind") > 0).agg(F.sum(F.when(F.col("kind") == WINDOWS, F.col("n")).otherwise(1))).first()[0] or 0
    runs = _construct(_fetch(texts, found, max(1, -(-n // collection)), length), length)
    known = found.filter(F.col("kind") == REPEAT).select("doc_id", "text_hash", "start", "n")
    return _cut(texts, known.unionByName(runs), length)


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept", "kept_text", "row")
