"""Language ID by string kernels, Nyström landmarks and kernel ridge regression.

A text is the set of its n-grams of 1 to 3 folded bytes (a blended spectrum,
presence only).  The kernel of two texts is the number of n-grams they share
over the geometric mean of their set sizes.  Landmarks are training texts; a
Nyström ridge regression against each language gives coefficients over the
landmarks.  The kernel's numerator is linear in the presence vector, so
landmark matrix and coefficients fold into one matrix, and a batch is scored by
one product of its presence rows with it.

Folding: letters of either case to one symbol, digits to one, other ASCII to
one, white space to one, UTF-8 continuation bytes by their low five bits (which
joins the cases of Latin letters), lead bytes to three.

Fitting uses at most ``TRAIN_DOCS`` labelled documents, ``TRAIN_PER_LABEL`` a
language, and ``SAMPLE_BYTES`` of text; of rows with one doc_id the shortest trains;
everything is scored, whole.

Edge cases: ``und`` with score 0 if the text is null, empty or has no letter;
with no usable training row every text is ``und``; repeated rows get equal
predictions; a null doc_id counts as not held out and trains nothing; an empty
table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Block, blocks, bounded_sample, sampled_rows, table

TRAIN_DOCS = 4096
TRAIN_PER_LABEL = 500
LANDMARKS = 160
RIDGE = 1e-2
CLASSES = 64
SIZES = (CLASSES, CLASSES**2, CLASSES**3)
ROWS = 256


def _folding() -> np.ndarray:
    b = np.arange(256)
    fold = np.full(256, 28)
    fold[np.isin(b, [9, 10, 11, 12, 13, 32])] = 0
    fold[48:58] = 27
    for first in (65, 97):
        fold[first : first + 26] = np.arange(1, 27)
    fold[0x80:0xC0] = 29 + (b[0x80:0xC0] & 31)
    fold[0xC0:0xC4], fold[0xC4:0xE0], fold[0xE0:] = 61, 62, 63
    return fold.astype(np.int32)


FOLD = _folding()


class Spectrum:
    """Presence rows of texts over a fixed set of columns, with the sizes of their whole n-gram sets."""

    def __init__(self) -> None:
        self.seen = np.zeros(sum(SIZES), dtype=bool)

    def codes(self, text: np.ndarray) -> list[np.ndarray]:
        c = FOLD[text]
        pair = c[:-1] * CLASSES + c[1:]
        return [c, pair + SIZES[0], pair[:-1] * CLASSES + c[2:] + SIZES[0] + SIZES[1]]

    def whole(self, text: np.ndarray) -> np.ndarray:
        """The sorted codes of all n-grams of a text."""
        self._mark(text)
        return np.flatnonzero(self.seen)

    def _mark(self, text: np.ndarray) -> None:
        self.seen[:] = False
        for codes in self.codes(text):
            self.seen[codes] = True

    def row(self, text: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, int]:
        self._mark(text)
        return self.seen[columns], int(np.count_nonzero(self.seen))


def has_letter(text: bytes) -> bool:
    """Whether a UTF-8 text has a letter."""
    if text.upper() != text.lower():
        return True
    return any(map(str.isalpha, text.decode())) if not text.isascii() else False


class Model:
    """The fitted classifier: columns, folded weights, languages."""

    def __init__(self, texts: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> None:
        self.languages = sorted(set(labels))
        spectrum = Spectrum()
        sets = [spectrum.whole(np.frombuffer(t, np.uint8)) for t in texts]
        y = np.asarray([self.languages.index(x) for x in labels])
        # Landmarks: in turn from each language, in the given (hashed) order.
        turn = np.zeros(len(y), np.int64)
        for k in range(len(self.languages)):
            turn[y == k] = np.arange((y == k).sum())
        chosen = np.lexsort([y, turn])[:landmarks]
        self.columns = np.unique(np.concatenate([sets[i] for i in chosen]))
        marks = np.zeros((len(chosen), len(self.columns)), np.float32)
        for r, i in enumerate(chosen):
            marks[r, np.searchsorted(self.columns, sets[i])] = 1
        marks /= np.sqrt(np.asarray([len(sets[i]) for i in chosen], np.float32))[:, None]
        k_nm = np.zeros((len(sets), len(chosen)), np.float32)
        for a in range(0, len(sets), ROWS):
            rows = np.zeros((min(ROWS, len(sets) - a), len(self.columns)), np.float32)
            for r, own in enumerate(sets[a : a + ROWS]):
                i = np.minimum(np.searchsorted(self.columns, own), len(self.columns) - 1)
                rows[r, i[self.columns[i] == own]] = 1
            k_nm[a : a + ROWS] = rows @ marks.T / np.sqrt(np.asarray([max(len(s), 1) for s in sets[a : a + ROWS]], np.float32))[:, None]
        target = np.where(y[:, None] == np.arange(len(self.languages)), 1.0, -1.0)
        # Languages weigh the same, however many texts they have.
        weight = 1.0 / np.bincount(y)[y] / len(self.languages)
        k = k_nm.astype(np.float64)
        k_mm = k[chosen]
        left = k.T @ (k * weight[:, None]) + ridge * k_mm / len(chosen) + 1e-9 * np.eye(len(chosen))
        alpha = np.linalg.solve(left, k.T @ (target * weight[:, None]))
        self.weights = (marks.T.astype(np.float64) @ alpha).astype(np.float32)

    def predict(self, block: Block) -> tuple[list[str], np.ndarray]:
        spectrum = Spectrum()
        names, scores = [], np.zeros(len(block))
        for a in range(0, len(block), ROWS):
            n = min(ROWS, len(block) - a)
            rows, sizes = np.zeros((n, len(self.columns)), dtype=bool), np.ones(n, np.float32)
            lettered = np.zeros(n, dtype=bool)
            for r in range(n):
                text = block.buf[block.offsets[a + r] : block.offsets[a + r + 1]]
                lettered[r] = has_letter(text.tobytes())
                if lettered[r]:
                    rows[r], sizes[r] = spectrum.row(text, self.columns)
            margin = rows.astype(np.float32) @ self.weights / np.sqrt(sizes)[:, None]
            best = margin.argmax(1)
            names += [self.languages[k] if ok else "und" for k, ok in zip(best.tolist(), lettered.tolist(), strict=True)]
            top = margin[np.arange(n), best]
            rest = np.partition(np.concatenate([margin, np.full((n, 1), -1, np.float32)], 1), -2, 1)[:, -2]
            # Half the margin over the runner-up: 1 for a sure text, 0 for a tie.
            scores[a : a + n] = np.where(lettered, np.clip((top - rest) / 2, 0, 1), 0)
        return names, scores


def held_out(mod: int, rest: int, key: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % mod == rest, F.lit(False))


def fit(labelled: DataFrame, most: int = TRAIN_DOCS, per_label: int = TRAIN_PER_LABEL) -> Model | None:
    """A model from rows (doc_id, text, lang); None if no row has a text with a letter and a language."""
    usable = labelled.filter("text is not null and lang is not null and doc_id is not null")
    ids = bounded_sample(usable.select("doc_id", "lang"), "lang", most, per_label)
    got = sampled_rows(usable.select("doc_id", "text", "lang"), ids)
    got = sorted((r for r in got if has_letter(r["text"].encode())), key=lambda r: (hash_of(r["doc_id"]), r["text"], r["lang"]))[:most]
    return Model([r["text"].encode() for r in got], [r["lang"] for r in got]) if got else None


def hash_of(doc_id: int) -> int:
    return (doc_id * 0x9E3779B97F4A7C15 + 0x7F4A7C15) % (1 << 64) >> 20


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row: doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches):
            names, scores = shared.value.predict(block) if shared.value else (["und"] * len(block), np.zeros(len(block)))
            yield pa.record_batch([block.ids, pa.array(names), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out(4, 2)))
    return identify(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
