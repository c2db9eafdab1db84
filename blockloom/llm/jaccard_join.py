"""N-gram Jaccard join by a MinHash LSH forest with exact verification.

A document is its set of 5-word shingles (lower-cased words; fewer words make
one shingle).  Documents with equal sets form a class and are joined once, for
their number of rows.

Each class has ``TREES`` signatures of ``DEPTH`` minima, 16 bits each.  A tree is
the sorted prefix trie of its signatures: a group of a depth is a run of
signatures that begin alike.

1. ``target_depth``: prefixes are shortened from the full depth until the chance
   that two sets at the threshold share one in some tree reaches ``RECALL``.
   Two classes meet if they share a prefix of that depth, and classes that meet
   no other leave the forest.
2. At the full depth the forest ties the classes that share a whole signature;
   all classes of a tie are compared with each other, unless the tie hangs
   together so loosely that its groups at the target depth are less work.
3. Then matched prefixes are shortened to the target depth, for what is not yet
   compared: groups of classes of several ties.  A pair of one tie is passed
   over, and one that meets in several trees is compared in the first.

Two classes are linked if they meet and their sets have a similarity of 0.8 or
more, exactly; how ties lie has no part in that.  Comparisons run in blocks of at
most ``BLOCK`` classes and about ``BLOCK_SHINGLES`` shingles, two blocks a task, so
ties and groups of any size are whole.  What leaves one is not pairs: for each
class the number of linked rows, and a spanning forest of the links, from which
components follow.

Result per row: class_id (the least doc_id of the component of links), rep_id
(the least doc_id of the rows with the same set), n_links (number of other rows
linked to it, equal sets included).

Edge cases: a null text, or one without words, is linked to nothing, and its
class_id is its own doc_id; repeated rows are rows of one class; different texts
under one doc_id are rows of their own; rows without doc_id take part like others
and have the least doc_id that their component has, or null; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Block, SpanHash, blocks, checkpoint, components, mix, releasing, skew_join, table
from .decontamination import LOWER, words

WORDS = 5
#: Similarity as a fraction of whole numbers, so that the bound is exact.
THRESHOLD = (4, 5)
TREES = 20
DEPTH = 8
RECALL = 0.9999
BLOCK = 512
BLOCK_SHINGLES = 4_000_000
COLUMNS = 4096
#: A tie is compared all with all if that takes at most so many times the pairs that its groups have.  Results are the same either way.
DENSE = 1.0

_MULTIPLIERS = np.random.default_rng(8).integers(1, 1 << 62, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xA0761D6478BD642F)


def meeting_chance(similarity: float, depth: int, trees: int = TREES) -> float:
    """The chance that two sets share a prefix of a depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def target_depth(threshold: float = THRESHOLD[0] / THRESHOLD[1], recall: float = RECALL) -> int:
    """The longest prefix whose chance of a meeting at the threshold is at least the recall."""
    depth = DEPTH
    while depth > 1 and meeting_chance(threshold, depth) < recall:
        depth -= 1
    return depth


def shingles(block: Block, hasher: SpanHash, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of a block's rows, sorted by row and hash: (row, hash)."""
    starts, _, hashes = words(LOWER[block.buf], block.offsets, hasher)
    row = block.rows_of(starts)
    if not len(starts):
        return row, hashes
    last = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(block)))])[row + 1]
    place = np.arange(len(row))
    first = np.concatenate([[True], row[1:] != row[:-1]])
    whole = place + n <= last
    key = np.zeros(len(row), np.uint64)
    for k in range(n):
        there = place + k < last
        key = np.where(there, key * _STEP + hashes[np.minimum(place + k, len(row) - 1)], key)
    keep = whole | first  # a text of fewer words is one shingle
    row, key = row[keep], mix(key[keep])
    order = np.lexsort([key, row])
    row, key = row[order], key[order]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])])
    return row[new], key[new]


def signatures(row: np.ndarray, key: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """For each row present, in order, its TREES * DEPTH minima, 16 bits of each."""
    firsts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    out = np.full((len(firsts), len(_MULTIPLIERS)), np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(key), step):
        part = key[a : a + step]
        r0 = int(np.searchsorted(firsts, a, side="right")) - 1
        cuts = firsts[r0:][firsts[r0:] < a + step] - a
        cuts[0] = max(cuts[0], 0)
        rows = slice(r0, r0 + len(cuts))
        for i, m in enumerate(_MULTIPLIERS):
            low = np.minimum.reduceat(((part * m) >> np.uint64(32)).astype(np.uint32), cuts)
            np.minimum(out[rows, i], low, out=out[rows, i])
    # The low bits of a least hash are as good as random, the high ones are not.
    return (mix(out.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)


def _set_digests(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each row present: where its shingles begin, two 64-bit sums over them, and their number."""
    firsts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    a, b = (np.add.reduceat(mix(key ^ np.uint64(k)), firsts).view(np.int64) for k in (1, 2))
    return firsts, a, b, np.diff(np.append(firsts, len(row)))


def _digests(texts: DataFrame) -> DataFrame:
    """Per row with words: doc_id, the text's key, the set's 128-bit digest and size, and the signature."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for block in blocks(batches):
            row, key = shingles(block, hasher)
            if not len(row):
                continue
            firsts, a, b, size = _set_digests(row, key)
            sig = [s.tobytes() for s in signatures(row, key)]
            of = pa.array(row[firsts])
            yield pa.record_batch([block.ids.take(of), block.batch["text_key"].take(of), pa.array(a), pa.array(b), pa.array(size, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "text_key", "set_a", "set_b", "size", "sig"])

    return texts.mapInArrow(digest, "doc_id long, text_key long, set_a long, set_b long, size long, sig binary")


def _forest(classes: DataFrame) -> DataFrame:
    """(node, tree, signature): a class in each tree."""
    width = 2 * DEPTH
    per_tree = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("tree"), F.col("sig").substr(t * width + 1, F.lit(width)).alias("key")))
    return classes.select("node", F.explode(per_tree).alias("t")).select("node", "t.tree", "t.key")


def _group(depth: int) -> Column:
    """The name of a prefix.  Should two prefixes share one, their classes are told apart when compared."""
    return F.xxhash64("tree", F.col("key").substr(1, 2 * depth))


class _Unit:
    """The classes of one comparison: two blocks (or one with itself) of a tie or of a group of one tree."""

    def __init__(self, tree: int, same: bool) -> None:
        self.tree, self.same = tree, same
        self.rows: list[tuple] = []

    def links(self, depth: int, threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes, the rows linked to each, and forest edges (class, class)."""
        nodes = np.asarray([r[0] for r in self.rows])
        counts = np.asarray([r[1] for r in self.rows], np.float64)
        left = np.asarray([r[2] for r in self.rows], dtype=bool)
        sets = [np.frombuffer(r[3], np.uint64) for r in self.rows]
        ties = np.asarray([r[5] for r in self.rows])
        sizes = np.asarray([len(s) for s in sets])
        which = np.repeat(np.arange(len(sets)), sizes)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = times[column] > 1
        which, column = which[shared], column[shared]
        number = np.cumsum(times > 1) - 1
        column = number[column]
        n_columns = int((times > 1).sum())
        common = np.zeros((len(sets), len(sets)), np.float32)
        order = np.argsort(column, kind="stable")
        which, column = which[order], column[order]
        for a in range(0, n_columns, COLUMNS):
            i, j = np.searchsorted(column, [a, a + COLUMNS])
            x = np.zeros((len(sets), min(COLUMNS, n_columns - a)), np.float32)
            x[which[i:j], column[i:j] - a] = 1
            common += x @ x.T
        up, down = threshold
        linked = (up + down) * common >= up * (sizes[:, None] + sizes[None, :])
        np.fill_diagonal(linked, False)
        if not self.same:
            linked &= left[:, None] != left[None, :]
        prefixes = np.frombuffer(b"".join(r[4] for r in self.rows), np.uint16).reshape(len(sets), TREES, DEPTH)[:, :, :depth]
        alike = lambda t: np.logical_and.reduce([prefixes[:, t, k][:, None] == prefixes[:, t, k][None, :] for k in range(depth)])
        if self.tree < 0:
            open_ = linked.copy()
            for t in range(TREES):
                if not open_.any():
                    break
                open_ &= ~alike(t)
            linked &= ~open_
        elif linked.any():
            linked &= (ties[:, None] != ties[None, :]) | (ties[:, None] < 0)
            linked &= alike(self.tree)
            for t in range(self.tree):
                linked &= ~alike(t)
        rows = linked @ counts
        # A spanning forest: each class to the least it reaches, over and over.
        order = np.argsort(nodes, kind="stable")
        rank = np.empty(len(sets), np.int64)
        rank[order] = np.arange(len(sets))
        low = rank.copy()
        while True:
            new = np.minimum(low, np.where(linked, low[None, :], len(sets)).min(1, initial=len(sets)))
            if (new == low).all():
                break
            low = new
        root = order[low]
        moved = root != np.arange(len(sets))
        return nodes, rows.astype(np.int64), nodes[moved], nodes[root[moved]]


_MEMBER = ["unit", "tree", "i", "j", "node", "n_rows", "block", "set", "sig", "tie"]


def _compare(members: DataFrame, depth: int, threshold: tuple[int, int]) -> DataFrame:
    """Rows (a, b, n): b null and n the number of linked rows of class a, or a forest edge a-b."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, name = None, None
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        n: list[np.ndarray] = []

        def close() -> None:
            if unit and len(unit.rows) > 1:
                nodes, rows, x, y = unit.links(depth, threshold)
                some = rows > 0
                a.extend([nodes[some], x])
                b.extend([np.full(some.sum(), -1), y])
                n.extend([rows[some], np.zeros(len(x), np.int64)])

        def out() -> pa.RecordBatch:
            got = pa.record_batch([pa.array(np.concatenate(v) if v else np.zeros(0, np.int64)) for v in (a, b, n)], names=["a", "b", "n"])
            for v in (a, b, n):
                v.clear()
            return got

        for batch in batches:
            for r in zip(*(batch[c].to_pylist() for c in _MEMBER), strict=True):
                if r[:4] != name:
                    close()
                    name, unit = r[:4], _Unit(r[1], r[2] == r[3])
                unit.rows.append((r[4], r[5], r[6] == r[2], *r[7:]))
            yield out()
        close()
        yield out()

    dealt = members.select(*_MEMBER).repartition("unit", "tree", "i", "j").sortWithinPartitions("unit", "tree", "i", "j", "node")
    return dealt.mapInArrow(releasing(compare), "a long, b long, n long")


def _sets(texts: DataFrame) -> DataFrame:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for block in blocks(batches):
            row, key = shingles(block, hasher)
            if not len(row):
                continue
            firsts, a, b, _ = _set_digests(row, key)
            ends = np.append(firsts[1:], len(row))
            own = [key[x:y].tobytes() for x, y in zip(firsts, ends, strict=True)]
            yield pa.record_batch([pa.array(a), pa.array(b), pa.array(own, pa.binary())], names=["set_a", "set_b", "set"])

    return texts.mapInArrow(sets, "set_a long, set_b long, set binary").dropDuplicates(["set_a", "set_b"])


def _units(forest: DataFrame, classes: DataFrame, depth: int) -> DataFrame:
    """Who is compared with whom: (unit, tree, node, tie, n, shingles); tree -1 for ties, and what a unit holds in all."""
    # Groups at the target depth with two classes or more; all else meets nothing.
    near = forest.withColumn("group", _group(depth))
    groups = near.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("group", "n")
    met = checkpoint(skew_join(near, groups, ["group"]).select("node", "tree", "group", "n", _group(DEPTH).alias("deep")))
    # Ties: classes that share a whole signature; each such group hangs on its least class.
    hubs = met.groupBy("deep").agg(F.min("node").alias("hub"), F.max("node").alias("far")).filter("hub < far").select("deep", "hub")
    tied = skew_join(met.select("node", "deep"), hubs, ["deep"]).select(F.col("node").alias("a"), F.col("hub").alias("b"))
    ties = checkpoint(components(tied).withColumnRenamed("root", "tie"))
    # All with all, or along the groups?  Whichever is less work.
    along = met.groupBy("node").agg(F.sum("n").alias("pairs"))
    size = classes.select("node", "size")
    per_tie = ties.join(along, "node").join(size, "node").groupBy("tie").agg(F.count(F.lit(1)).alias("n"), F.sum("pairs").alias("pairs"), F.sum("size").alias("shingles")).withColumn("dense", F.col("n") * F.col("n") <= DENSE * F.col("pairs"))
    dense = skew_join(ties, per_tie.filter("dense"), ["tie"])
    dense = checkpoint(dense.select("node", "tie", "n", "shingles"))
    # Groups at the target depth that hold classes of several ties (or of none).
    rest = met.join(dense.select("node", "tie"), "node", "left").join(size, "node").withColumn("own", F.coalesce("tie", -F.col("node") - 1))
    open_ = rest.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("shingles"), F.min("own").alias("x"), F.max("own").alias("y")).filter("x < y").select("group", "n", "shingles")
    rest = checkpoint(rest.select("node", "tree", "group", "tie"))
    open_units = skew_join(rest, open_, ["group"]).select(F.col("group").alias("unit"), "tree", "node", F.coalesce("tie", F.lit(-1)).alias("tie"), "n", "shingles")
    return dense.select(F.col("tie").alias("unit"), F.lit(-1).alias("tree"), "node", "tie", "n", "shingles").unionByName(open_units)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


SAME = ["set_a", "set_b", "size"]
#: Bits of the filter that texts pass before they are dealt out; 64 a row, so at most 8 MB are broadcast.
FILTER_BITS = 1 << 25


def _marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows whose (doc_id, text_key) has its bit in a filter of wanted's (id, key): all of those, and by chance some others, more the fuller the filter."""
    bit = lambda *keys: F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))
    bits = wanted.select(bit("id", "key").alias("bit")).groupBy(F.expr("shiftright(bit, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, int(bit & 63)))").alias("mask"))
    at = rows.withColumn("bit", bit("doc_id", "text_key"))
    return at.join(F.broadcast(bits), (F.expr("shiftright(bit, 6)") == F.col("word")) & F.expr("mask & shiftleft(1L, int(bit & 63)) != 0"), "left_semi").drop("bit")


def _linked(texts: DataFrame, threshold: tuple[int, int], recall: float) -> tuple[DataFrame, DataFrame]:
    """The rows with words (doc_id, text_key, set), and the classes: set, n_rows, linked, root, first (the first row: no_id, doc_id, text_key)."""
    depth = target_depth(threshold[0] / threshold[1], recall)
    digests = checkpoint(_digests(texts))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key"))
    grouped = digests.groupBy(*SAME).agg(first.alias("first"), F.count(F.lit(1)).alias("n_rows"), F.min("sig").alias("sig"))
    classes = checkpoint(grouped.withColumn("node", F.monotonically_increasing_id()))
    units = checkpoint(_units(_forest(classes), classes, depth))
    blocks_ = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    units = units.withColumn("n_blocks", blocks_).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    compared = classes.join(units.select("node").distinct(), "node", "left_semi")
    wanted = compared.select(F.col("first.doc_id").alias("id"), F.col("first.text_key").alias("key"))
    standing = _marked(texts, wanted).join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_key") == F.col("key")), "left_semi")
    with_sets = compared.join(_sets(standing), ["set_a", "set_b"]).select("node", "n_rows", "sig", "set")
    # Block k meets blocks 0..k as (j, k) and the later ones as (k, j).
    members = units.join(with_sets, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    members = members.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    found = checkpoint(_compare(members, depth, threshold))
    counts = found.filter("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    roots = components(found.filter("b >= 0").select("a", "b"))
    joined = classes.drop("sig").join(counts, "node", "left").join(roots, "node", "left")
    return digests.drop("sig"), checkpoint(joined.select(*SAME, "n_rows", F.coalesce("linked", F.lit(0)).alias("linked"), F.coalesce("root", "node").alias("root"), "first"))


def _with_head(classes: DataFrame) -> DataFrame:
    """Classes with the first row of their component."""
    return skew_join(classes, classes.groupBy("root").agg(F.min("first").alias("head")), ["root"])


def similarity_classes(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """Per row: doc_id, class_id, rep_id, n_links."""
    texts = _texts(docs)
    digests, classes = _linked(texts, threshold, recall)
    per = _with_head(classes).select(*SAME, "n_rows", F.col("head.doc_id").alias("class_id"), F.col("first.doc_id").alias("rep_id"), (F.col("n_rows") - 1 + F.col("linked")).alias("n_links"))
    linked = skew_join(digests.select("doc_id", *SAME), per, SAME).select("doc_id", "class_id", "rep_id", "n_links")
    alone = _wordless(texts).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("rep_id"), F.lit(0).cast("long").alias("n_links"))
    return linked.unionByName(alone)


def keep_one(docs: DataFrame, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The rows of docs, but of each component of links only one: the row of least doc_id (rows without come last), and one of equal rows.  Rows without words stay."""
    texts = _texts(docs)
    digests, classes = _linked(texts, threshold, recall)
    per = _with_head(classes).select(*SAME, "n_rows", "head")
    rows = skew_join(digests.select("doc_id", "text_key", *SAME), per, SAME)
    names = ["_op8_id", "_op8_key"]
    chosen = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("text_key") == F.col("head.text_key"))
    named = rows.select(F.col("doc_id").alias(names[0]), F.col("text_key").alias(names[1]), chosen.alias("chosen"))
    gone = checkpoint(named.groupBy(*names).agg(F.max("chosen").alias("chosen"), F.count(F.lit(1)).alias("n")).filter("n > 1 OR NOT chosen"))
    match = lambda d: d["_op8_doc"].eqNullSafe(gone[names[0]]) & (d["_op8_text"] == gone[names[1]])
    keyed = docs.withColumns({"_op8_doc": F.col("doc_id").cast("long"), "_op8_text": F.xxhash64(F.col("text").cast("string"))})
    left = keyed.join(gone, match(keyed), "left_anti").select(docs.columns)
    if gone.filter("chosen").isEmpty():
        return left
    # Of rows given several times one stays, found by partial aggregation.
    again = keyed.join(gone.filter("chosen"), match(keyed), "left_semi")
    one = again.groupBy("_op8_doc", "_op8_text").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("row")).select("row.*")
    return left.unionByName(one)


def _wordless(texts: DataFrame) -> DataFrame:
    """Rows without a word."""
    return texts.filter(~F.coalesce(F.col("text").rlike("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]"), F.lit(False))).select("doc_id")


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similarity_classes(table(spark, sf_dir, "documents"))
