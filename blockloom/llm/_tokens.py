"""Token ids of whole texts by a public tokenizer, through a table of words.

The vocabulary used here drops white space and never merges across it, so the
ids of a text are those of its ASCII-white-space-separated words, one after
another.  Each distinct word goes through the library once; texts then become
gathers from the table.  ``tests/llm`` holds this against whole-text encoding.
"""

from __future__ import annotations

import os
import re

import numpy as np
from tokenizers import Tokenizer

from ._common import Block, ragged

#: Words kept at a time; the table starts anew beyond this, so memory is bounded.
TABLE_WORDS = 700_000
VOCABULARY = "word_bpe_49k.json"
#: New words that are one run of Latin letters, or one and a run of marks, are encoded so many to a text.
TOGETHER = 64
_PLAIN = re.compile("([a-z\u00df-\u00f6\u00f8-\u00ff]+)([.,!;:?%*&#$|]*)")


def vocabulary_path(path: str | None = None) -> str:
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class _Slots(dict):
    def __init__(self) -> None:
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = slot = len(self)
        self.new.append(word)
        return slot


class WordEncoder:
    def __init__(self, path: str | None = None, table_words: int = TABLE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(vocabulary_path(path))
        self.limit = table_words
        vocabulary = self.tokenizer.get_vocab()
        self.word_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.word_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.n_bytes = np.zeros(len(self.word_end), np.int64)  # a token of a byte-level vocabulary has a character for each
        self.n_bytes[list(vocabulary.values())] = [len(t.removesuffix("</w>")) for t in vocabulary]
        self._reset()

    def _reset(self) -> None:
        self.slots = _Slots()
        self.ids = np.zeros(0, np.uint32)
        self.lengths = np.zeros(0, np.int64)

    def _learn(self) -> None:
        new = [w.decode() for w in self.slots.new]
        self.slots.new.clear()
        if not new:
            return
        # Numbers of word ends that plain words have; 0 for words that are encoded alone.
        ends = np.fromiter((1 + bool(m[2]) if (m := _PLAIN.fullmatch(w)) else 0 for w in new), np.int64, len(new))
        plain = np.flatnonzero(ends)
        ids, counts = self._together([new[i] for i in plain], ends[plain])
        alone = np.flatnonzero(ends == 0) if len(ids) or not len(plain) else np.arange(len(new))
        if not len(ids):
            plain = plain[:0]
        single = [x.ids for x in self.tokenizer.encode_batch_fast([new[i] for i in alone], add_special_tokens=False)]
        lengths = np.zeros(len(new), np.int64)
        lengths[plain] = counts
        lengths[alone] = np.fromiter(map(len, single), np.int64, len(single))
        starts = np.cumsum(lengths) - lengths
        out = np.empty(int(lengths.sum()), np.uint32)
        out[ragged(starts[plain], counts)] = ids
        out[ragged(starts[alone], lengths[alone])] = np.fromiter((i for x in single for i in x), np.uint32)
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, out])

    def _together(self, plain: list[str], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of plain words, and each word's number of ids, which the word-end marks of the ids tell."""
        texts = [" ".join(plain[i : i + TOGETHER]) for i in range(0, len(plain), TOGETHER)]
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter((i for x in found for i in x), np.uint32)
        last = np.flatnonzero(self.word_end[ids])
        if len(last) != ends.sum():  # not a vocabulary of this kind: encode alone
            return ids[:0], np.zeros(0, np.int64)
        bounds = last[np.cumsum(ends) - 1] + 1 if len(ends) else last
        # Each word's ids stand for as many bytes as the word has, so no two errors that cancel pass.
        if (np.cumsum(self.n_bytes[ids])[bounds - 1] != np.cumsum([len(w.encode()) for w in plain])).any():
            return ids[:0], np.zeros(0, np.int64)
        return ids, np.diff(bounds, prepend=0)

    def __call__(self, block: Block, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids, each row's followed by end_id, and the rows' numbers of ids."""
        if len(self.slots) > self.limit:
            self._reset()
        get, parts = self.slots.__getitem__, []
        for i in range(len(block)):
            text = block.text(i)
            # Lower-casing early saves table entries; a spelled-out special token is matched before it.
            words = (text if b"<|" in text else text.lower()).split()
            parts.append(np.fromiter(map(get, words), np.int64, len(words)))
        self._learn()
        n_words = np.fromiter(map(len, parts), np.int64, len(parts))
        slots = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        lengths = self.lengths[slots]
        sums = np.concatenate([[0], np.cumsum(lengths)])
        bounds = np.concatenate([[0], np.cumsum(n_words)])
        counts = sums[bounds[1:]] - sums[bounds[:-1]]
        starts = np.cumsum(self.lengths) - self.lengths
        ids = self.ids[ragged(starts[slots], lengths)]
        out = np.full(len(ids) + len(counts), end_id, np.uint32)
        keep = np.ones(len(out), dtype=bool)
        keep[np.cumsum(counts + 1) - 1] = False
        out[keep] = ids
        return out, counts + 1


_ENCODERS: dict[str | None, WordEncoder] = {}


def encoder(path: str | None = None) -> WordEncoder:
    """This process's encoder of a vocabulary; a worker's later tasks find the words of its earlier ones."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
