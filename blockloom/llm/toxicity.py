"""Toxicity by a linear-chain conditional random field over words.

Document labels become labelled tokens first: a word is offending where it is
far commoner, or begins with a stem far commoner, in toxic than in clean
training documents (``seed_words``); its occurrences in toxic documents are tagged 1, all other tokens 0.  A two-state
chain is then fitted on windows that hold every occurrence of such a word, with
its neighbours, wherever in a document it is, and on a window by turns elsewhere
(``windows``; a document of fewer words than a window is one window):
emissions from the word's, the previous and the next word's identity (words of
no training evidence share one), transitions and start.  Forward-backward gives
each token's marginal.  A document's score is a logistic curve of two
aggregates of its marginals -- the log-odds that any token is toxic, and the
expected number of toxic tokens -- fitted on the training documents; tokens with
a marginal of at least 0.5 give the offending character offsets.

Fitting uses at most ``TRAIN_DOCS`` labelled documents, half of them for each
label, and ``SAMPLE_BYTES`` of text; of rows with one doc_id the shortest text trains; every document is scored, over its whole text.

Words are lower-cased runs of letters of any script (apostrophes inside included).

Edge cases: a null or empty text has no tokens and gets the score of the
smallest evidence; several labels of one document count as their largest; null
labels and ids train nothing; with no usable training row every score is 0;
repeated rows get equal scores; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import blocks, bounded_sample, sampled_rows, table
from .language_id import hash_of, held_out

TRAIN_DOCS = 6000
VOCABULARY = 4000
WINDOW = 10
FIT_WINDOWS = 20_000
BLOCK_BYTES = 2 << 20
WORD = re.compile(rb"[A-Za-z\x80-\xff]+(?:'[A-Za-z\x80-\xff]+)*")


_MARK = re.compile(r"[^\x00-\x7f\w]|[^\x00-\x7f\D]")


def folded(text: bytes) -> bytes:
    """The text in lower case, with marks and digits beyond ASCII blanked; as many characters as before."""
    if text.isascii():
        return text.lower()
    plain = text.decode()
    low = plain.lower()
    if len(low) != len(plain):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in plain)
    return _MARK.sub(" ", low).encode()


def tokens(text: bytes) -> list[bytes]:
    return WORD.findall(folded(text))


STEMS = range(5, 11)


def numbered(texts: Iterator[bytes]) -> tuple[list[bytes], list[np.ndarray]]:
    """The distinct words of all texts, and each text's words as their numbers."""
    number: dict[bytes, int] = {}
    rows = [np.asarray([number.setdefault(w, len(number)) for w in tokens(t)], np.int32) for t in texts]
    return list(number), rows


def seed_words(lexicon: list[bytes], rows: list[np.ndarray], toxic: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """Words and word stems whose documents are toxic far more often than documents are: in 4 (stems: 8) toxic documents at least, with a lower confidence bound (2.6 deviations) of their odds ratio above 4.

    The bound is that of the log-odds or, for words too rare for it, that of the
    likelihood ratio of the toxic share among a word's documents, which a rare
    word has ``p`` of at an odds ratio of 4.
    """
    n_bad, n_good = max(int(toxic.sum()), 1), max(int((~toxic).sum()), 1)
    own = [np.unique(r) for r in rows]

    def chosen(names: list[bytes], features: Iterator[np.ndarray], least: int) -> list[bytes]:
        counts = np.zeros((2, len(names)))
        for found, t in zip(features, toxic, strict=True):
            counts[int(t), found] += 1
        b, a = counts
        odds = np.log((a + 0.5) / (n_bad - a + 0.5)) - np.log((b + 0.5) / (n_good - b + 0.5))
        spread = (1 / (a + 0.5) + 1 / (n_bad - a + 0.5) + 1 / (b + 0.5) + 1 / (n_good - b + 0.5)) ** 0.5
        p = 4 * n_bad / (4 * n_bad + n_good)
        n = np.maximum(a + b, 1)
        ratio = 2 * (a * np.log(np.maximum(a, 1) / (n * p)) + b * np.log(np.maximum(b, 1) / (n * (1 - p))))
        sure = (odds - 2.6 * spread > np.log(4)) | ((a > n * p) & (ratio > 2.6**2))
        return sorted(names[k] for k in np.flatnonzero((a >= least) & sure))

    # Each word's stems by number; 0 stands for none.
    stems: dict[bytes, int] = {b"": 0}
    of = np.asarray([[stems.setdefault(w[:k], len(stems)) if len(w) > k else 0 for k in STEMS] for w in lexicon], np.int32).reshape(-1, len(STEMS))
    distinct = (found[found > 0] for found in (np.unique(of[o]) for o in own))
    return chosen(lexicon, iter(own), 4), chosen(list(stems), distinct, 8)


class ChainModel:
    """Two-state chain: emissions by word, previous word and next word.

    A word outside the vocabulary is its longest known stem, or else 0.
    """

    def __init__(self, vocabulary: list[bytes], stems: list[bytes]) -> None:
        self.index = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.stems = {w: len(vocabulary) + 1 + i for i, w in enumerate(stems)}
        n = len(vocabulary) + len(stems) + 1
        self.emit = np.zeros((3, n))  # score of state 1 over state 0
        self.bias = -3.0
        self.trans = np.zeros((2, 2))
        self.curve = np.asarray([0.0, 1.0, 0.0])

    def encode(self, words: list[bytes]) -> np.ndarray:
        get, stem = self.index.get, self.stem
        return np.fromiter((get(w) or stem(w) for w in words), np.int32, len(words))

    def stem(self, word: bytes) -> int:
        if len(word) > STEMS[0] and self.stems:
            for k in range(min(STEMS[-1], len(word) - 1), STEMS[0] - 1, -1):
                if found := self.stems.get(word[:k]):
                    return found
        return 0

    def unary(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of state 1 by place for rows of word numbers, -1 outside the text."""
        own = self.emit[0][np.maximum(x, 0)] + self.bias
        own[..., 1:] += self.emit[1][np.maximum(x[..., :-1], 0)]
        own[..., :-1] += self.emit[2][np.maximum(x[..., 1:], 0)] * (x[..., 1:] >= 0)
        return own

    def marginals(self, unary: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals of state 1 (rows x places; rows sorted by falling length), and the scaled forward and backward messages."""
        n, t = unary.shape
        psi = np.exp(self.trans)
        u = np.exp(np.clip(unary, -30, 30))
        f = np.zeros((n, t, 2))
        b = np.ones((n, t, 2))
        active = np.searchsorted(-length, -np.arange(t), side="left")
        for k in range(t):
            m = active[k]
            if not m:
                break
            if k:
                p = f[:m, k - 1] @ psi
            else:
                p = np.ones((m, 2))
            p[:, 1] *= u[:m, k]
            f[:m, k] = p / p.sum(1, keepdims=True)
        for k in range(t - 2, -1, -1):
            m = active[k + 1]
            if not m:
                continue
            q = b[:m, k + 1].copy()
            q[:, 1] *= u[:m, k + 1]
            q = q @ psi.T
            b[:m, k] = q / q.sum(1, keepdims=True)
        p = f * b
        return p[..., 1] / np.maximum(p.sum(-1), 1e-300), f, b

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
        """Sums over windows (sorted by falling length, -1 after their end) of the log-likelihood's gradients."""
        there = x >= 0
        unary = self.unary(x)
        p, f, b = self.marginals(unary, there.sum(1))
        gap = y - p
        word = np.maximum(x, 0)
        g_emit = np.zeros_like(self.emit)
        g_emit[0] = np.bincount(word.ravel(), gap.ravel(), self.emit.shape[1])
        g_emit[1] = np.bincount(word[:, :-1].ravel(), gap[:, 1:].ravel(), self.emit.shape[1])
        g_emit[2] = np.bincount(word[:, 1:].ravel(), (gap[:, :-1] * there[:, 1:]).ravel(), self.emit.shape[1])
        after = b[:, 1:].copy()
        after[..., 1] *= np.exp(np.clip(unary[:, 1:], -30, 30))
        pair = (f[:, :-1, :, None] * np.exp(self.trans) * after[:, :, None, :])[there[:, 1:]]
        pair /= pair.sum((1, 2), keepdims=True)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[:, :-1][there[:, 1:]], y[:, 1:][there[:, 1:]]), 1.0)
        return g_emit, float(gap.sum()), seen - pair.sum(0)

    def fit(self, x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, decay: float = 1e-3) -> None:
        """Gradient ascent (Adam) of the mean log-likelihood of windows, -1 after their end, FIT_WINDOWS at a time."""
        n = len(x)
        if not n:
            return
        order = np.argsort(-(x >= 0).sum(1), kind="stable")
        x, y = x[order], y[order]
        state = [np.zeros_like(p) for p in (self.emit, np.zeros(1), self.trans)] * 2
        state = [s.copy() for s in state]
        for step in range(1, rounds + 1):
            g_emit, g_bias, g_trans = np.zeros_like(self.emit), 0.0, np.zeros((2, 2))
            for k in range(0, n, FIT_WINDOWS):
                e, o, r = self.gradients(x[k : k + FIT_WINDOWS], y[k : k + FIT_WINDOWS])
                g_emit, g_bias, g_trans = g_emit + e, g_bias + o, g_trans + r
            grads = [g_emit / n - decay * self.emit / n - 1e-5 * self.emit, np.asarray([g_bias / n]), g_trans / n - decay * self.trans]
            values = [self.emit, np.asarray([self.bias]), self.trans]
            for i, g in enumerate(grads):
                state[i] = 0.9 * state[i] + 0.1 * g
                state[i + 3] = 0.999 * state[i + 3] + 0.001 * g * g
                values[i] = values[i] + rate * (state[i] / (1 - 0.9**step)) / (np.sqrt(state[i + 3] / (1 - 0.999**step)) + 1e-8)
            self.emit, self.bias, self.trans = values[0], float(values[1][0]), values[2]

    def tag(self, rows: list[np.ndarray], cells: int = 400_000) -> list[np.ndarray]:
        """Each row's marginals."""
        order = sorted(range(len(rows)), key=lambda i: -len(rows[i]))
        out: list[np.ndarray] = [np.zeros(0)] * len(rows)
        at = 0
        while at < len(order):
            longest = max(len(rows[order[at]]), 1)
            some = order[at : at + max(1, cells // longest)]
            x = np.full((len(some), longest), -1, np.int32)
            for r, i in enumerate(some):
                x[r, : len(rows[i])] = rows[i]
            length = np.asarray([len(rows[i]) for i in some])
            p, _, _ = self.marginals(self.unary(x), length)
            for r, i in enumerate(some):
                out[i] = p[r, : len(rows[i])]
            at += len(some)
        return out

    @staticmethod
    def evidence(marginals: list[np.ndarray]) -> np.ndarray:
        """Rows (1, log-odds that any token is toxic, expected number), both kept in a sane range."""
        none = np.asarray([np.log1p(-np.minimum(m, 1 - 1e-9)).sum() for m in marginals])
        any_ = np.clip(np.log(np.maximum(-np.expm1(none), 1e-12)) - none, -12, 12)
        count = np.minimum([m.sum() for m in marginals], 5.0)
        return np.stack([np.ones(len(marginals)), any_, count], 1)

    def score(self, marginals: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-self.evidence(marginals) @ self.curve))

    def calibrate(self, marginals: list[np.ndarray], toxic: np.ndarray) -> None:
        """Logistic regression by Newton steps, the labels weighing as they come."""
        a = self.evidence(marginals)
        w = np.zeros(3)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            grad = a.T @ (toxic - p) - 0.01 * w
            w += np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + 0.01 * np.eye(3), grad)
        self.curve = w


def windows(codes: np.ndarray, marks: np.ndarray, turn: int) -> np.ndarray:
    """Windows of a document's word numbers, -1 after its end: together they hold every marked word with both its neighbours, and one more is placed by turn."""
    width, n = 2 * WINDOW + 1, len(codes)
    if n <= width:
        out = np.full((min(n, 1), width), -1, np.int32)
        out[:, :n] = codes
        return out
    begins: list[int] = []
    for m in np.flatnonzero(marks).tolist():
        # Each window is centred on the first marked word that none before holds.
        if not begins or m + 1 >= begins[-1] + width < n:
            begins.append(min(max(m - WINDOW, 0), n - width))
    begins.append(min(max(turn % n - WINDOW, 0), n - width))
    return codes[np.asarray(begins)[:, None] + np.arange(width)].astype(np.int32)


def train(texts: Iterator[bytes], toxic: np.ndarray) -> ChainModel:
    lexicon, words = numbered(texts)
    seeds, stems = seed_words(lexicon, words, toxic)
    times = np.zeros(len(lexicon), np.int64)
    for row in words:
        times[np.unique(row)] += 1
    common = sorted(zip(times.tolist(), lexicon, strict=True), key=lambda p: (-p[0], p[1]))
    bad = set(seeds)
    plain = ChainModel([], stems)
    vocabulary = seeds + [w for n, w in common[:VOCABULARY] if n >= 5 and w not in bad and not plain.stem(w)]
    model = ChainModel(vocabulary[: max(VOCABULARY, len(seeds))], stems)
    marked = {*(model.index[w] for w in seeds), *model.stems.values()}
    coded = model.encode(lexicon)
    offending = np.zeros(model.emit.shape[1], dtype=bool)
    offending[list(marked)] = True
    x, y = [], []
    for k, (row, t) in enumerate(zip(words, toxic, strict=True)):
        codes = coded[row]
        own = windows(codes, offending[codes], k * 7919)
        x.append(own)
        y.append(((own >= 0) & offending[own] & bool(t)).astype(np.int8))
    if x:
        model.fit(np.concatenate(x), np.concatenate(y))
    model.calibrate(model.tag([coded[r] for r in words]), toxic.astype(float))
    return model


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> ChainModel | None:
    """A model from documents and their labels (doc_id, toxic); None without both kinds of labelled text."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    ids = bounded_sample(marks, "toxic", most, most // 2)
    got = sampled_rows(docs.filter("text is not null").select("doc_id", "text"), ids)
    toxic = {r["doc_id"]: r["toxic"] for r in marks.join(F.broadcast(ids), "doc_id").collect()}
    got = sorted(got, key=lambda r: (hash_of(r["doc_id"]), r["text"]))[:most]
    y = np.asarray([toxic[r["doc_id"]] for r in got], dtype=bool)
    return train((r["text"].encode() for r in got), y) if y.any() and not y.all() else None


def tag(docs: DataFrame, model: ChainModel | None) -> DataFrame:
    """Per row: doc_id, score, predicted, and the offending character spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, limit=BLOCK_BYTES):
            texts = [block.text(i) for i in range(len(block))]
            spans: list[list[list[int]]] = [[] for _ in texts]
            scores = np.zeros(len(texts))
            if model := shared.value:
                marginals = model.tag([model.encode(tokens(t)) for t in texts])
                scores = model.score(marginals)
                for i, m in enumerate(marginals):
                    if len(m) and m.max() >= 0.5:
                        low = folded(texts[i])
                        found = list(WORD.finditer(low))
                        spans[i] = [[len(low[: found[k].start()].decode()), len(low[: found[k].end()].decode())] for k in np.flatnonzero(m >= 0.5)]
            yield pa.record_batch([block.ids, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.list_(pa.int64())))], names=["doc_id", "score", "predicted", "spans"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(scored, "doc_id long, score double, predicted int, spans array<array<long>>")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    kept = ~held_out(5, 0)
    model = fit(docs.filter(kept), table(spark, sf_dir, "labels").filter(kept))
    return tag(docs, model).select("doc_id", held_out(5, 0).alias("held_out"), "score", "predicted", "spans")
