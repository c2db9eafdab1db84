"""Repetition coverage: quality rules from rolling hashes of word n-grams, in numpy.

All words and lines of a block are hashed from one running sum and numbered by
hash; words and lines of one number are compared byte for byte.  The key of the
n-gram at a word rolls on from that of the (n-1)-gram there and one more word;
keys are whole numbers that stand for one n-gram of one text each, so counts are
exact.  An n-gram can only repeat where its first n-1 words do, so each length
looks at the places that the one before left over.  The characters inside repeats of n-grams (the first
occurrence is no repeat; overlaps count once) and inside repeated lines, as
shares of the characters in words, are held against ``RULES``.

A word is a run of bytes other than space and \\t..\\r.

Edge cases: a null or empty text has no words and fails; repeated rows are
judged each by itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Block, SpanHash, blocks, span_ids, spans, table

LENGTHS = range(2, 11)
#: Largest shares allowed: of characters in repeated n-grams by n (2 to 4: of the most frequent one; 5 to 10: of all repeated), in repeated lines, of repeated lines; symbols per word; words' mean length.
RULES = {
    "top": {2: 0.20, 3: 0.18, 4: 0.16},
    "all": {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10},
    "line_chars": 0.20,
    "lines": 0.30,
    "symbols": 0.10,
    "mean_word": (3.0, 12.0),
}
MIN_WORDS = 50
BASE_WINDOW = 3

_BYTES = np.arange(256)
SPACE = (_BYTES == 0x20) | ((_BYTES >= 9) & (_BYTES <= 13))
SYMBOL = np.isin(_BYTES, list(b"#*$%&|<>"))


def _groups(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of numbers: the (stable) order that sorts them, the group of each in that order, the groups' sizes."""
    key = first.astype(np.int64) * (int(second.max(initial=0)) + 1) + second
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    group = np.cumsum(new) - 1
    return order, group, np.bincount(group, minlength=0)


def _covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n words lie in the k-word windows that begin at the places."""
    depth = np.bincount(at, minlength=n + 1) - np.bincount(at + k, minlength=n + 1)
    return np.cumsum(depth[:n]) > 0


def measure(block: Block, hasher: SpanHash, lengths: range = LENGTHS) -> dict[str, np.ndarray]:
    n = len(block)
    member = ~SPACE[block.buf]
    starts, ends = spans(member, block.offsets)
    row = block.rows_of(starts)
    n_words = np.bincount(row, minlength=n)
    letters = member & ((block.buf & 0xC0) != 0x80)
    points = np.concatenate([[0], np.cumsum(letters, dtype=np.int64)])
    chars = points[ends] - points[starts]
    word_chars = np.bincount(row, chars, n).astype(np.int64)
    out = {"n_words": n_words, "word_chars": word_chars, "n_symbols": block.per_row(SYMBOL[block.buf])}

    # Lines: runs without \n; only those with a word count.
    a, b = spans(block.buf != 10, block.offsets)
    line_chars = points[b] - points[a]
    a, b, line_chars = a[line_chars > 0], b[line_chars > 0], line_chars[line_chars > 0]
    line_row = block.rows_of(a)
    order, group, _ = _groups(line_row, span_ids(block.buf, a, b, hasher))
    again = np.ones(len(a), dtype=bool)  # a stable order has a group's earliest line first
    if len(a):
        again[order[np.concatenate([[True], group[1:] != group[:-1]])]] = False
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=n)
    out["dup_line_chars"] = np.bincount(line_row[again], line_chars[again], n)

    # n-grams, from the places where shorter ones repeat.
    words = span_ids(block.buf, starts, ends, hasher)
    bounds = np.concatenate([[0], np.cumsum(n_words)])
    last = bounds[row + 1]
    # gram: the number of the text's n-gram at each place; a word's to begin with, so n-grams of different texts differ.
    at, gram = np.arange(len(starts)), np.empty(len(starts), np.int64)
    order, group, _ = _groups(row, words)
    gram[order] = group
    weight = np.concatenate([[0], np.cumsum(chars)])
    for k in range(2, max(lengths) + 1):
        ok = at + k <= last[at]
        at, gram = at[ok], gram[ok]
        order, group, sizes = _groups(gram, words[at + k - 1])
        gram = np.empty(len(at), np.int64)
        gram[order] = group
        twice = np.zeros(len(at), dtype=bool)
        twice[order] = sizes[group] >= 2 if len(at) else False
        if k in RULES["top"] and len(at):
            first = order[np.concatenate([[True], group[1:] != group[:-1]])]
            share = np.where(sizes >= 2, sizes * (weight[at[first] + k] - weight[at[first]]), 0)
            top = np.zeros(n)
            np.maximum.at(top, row[at[first]], share)
            out[f"top_{k}"] = top
        elif k in RULES["top"]:
            out[f"top_{k}"] = np.zeros(n)
        later = twice.copy()  # all but the first of each
        if len(at):
            later[order[np.concatenate([[True], group[1:] != group[:-1]])]] = False
        covered = _covered(at[later], k, len(starts))
        out[f"dup_{k}"] = np.bincount(row[covered], chars[covered], n)
        if k == BASE_WINDOW:
            covered = _covered(at[twice], k, len(starts))
            out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
        at, gram = at[twice], gram[twice]
    return out


def verdict(m: dict[str, np.ndarray]) -> np.ndarray:
    """True where no rule is broken."""
    total = np.maximum(m["word_chars"], 1)
    ok = m["dup_line_chars"] <= RULES["line_chars"] * total
    ok &= m["n_dup_lines"] <= RULES["lines"] * np.maximum(m["n_lines"], 1)
    ok &= m["n_symbols"] <= RULES["symbols"] * np.maximum(m["n_words"], 1)
    mean = m["word_chars"] / np.maximum(m["n_words"], 1)
    ok &= (mean >= RULES["mean_word"][0]) & (mean <= RULES["mean_word"][1])
    for k, most in RULES["top"].items():
        ok &= m[f"top_{k}"] <= most * total
    for k, most in RULES["all"].items():
        ok &= m[f"dup_{k}"] <= most * total
    return ok


def score(docs: DataFrame) -> DataFrame:
    """Per document the base counts, base_failed, kept, and the measured shares."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shares = ["dup_line_chars", *(f"dup_{k}" for k in LENGTHS)]
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in counts) + ", base_failed boolean, kept boolean, " + ", ".join(f"{c}_share double" for c in shares)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for block in blocks(batches):
            m = measure(block, hasher)
            failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])
            kept = ~failed & verdict(m)
            total = np.maximum(m["word_chars"], 1)
            yield pa.record_batch([block.ids, *(pa.array(m[c].astype(np.int64)) for c in counts), pa.array(failed), pa.array(kept), *(pa.array(m[c] / total) for c in shares)], names=["doc_id", *counts, "base_failed", "kept", *(f"{c}_share" for c in shares)])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(measured, schema)


def op6_quality_rules(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
