"""The training-data operators against brute force, on small tables with the awkward cases in them."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from blockloom.llm import _common, decontamination, jaccard_join, language_id, license_scan, packing, preferences, quality, suffix_dedup, token_output, toxicity
from blockloom.llm._common import blocks, components
from blockloom.llm._tokens import WordEncoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row int, places string, bucket int"


@pytest.fixture(scope="module")
def docs(spark):
    """Test documents and null, empty, tiny, repeated and long ones, with clashing column names beside them."""
    some = spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, "x", 2) for r in some]
    base = some[5].text
    extra = [None, "", "a", " \n\t ", "12 34 !!", base, base, base.replace("a", "e", 1), base + " and more words at the end", ("again and again " * 9000), "é" * 120, "日本語のテキスト" * 30]
    rows += [(1000 + i, t, None if i % 3 else "en", None, None, None, None, None) for i, t in enumerate(extra)]
    return spark.createDataFrame(rows + [rows[0], rows[-7]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))


@pytest.mark.parametrize("hot", [20_000, 1])
def test_suffix_dedup(docs, empty, hot):
    got, seen = by_id(suffix_dedup.remove_repeats(docs, hot=hot, collection=50)), set()
    for i, t in sorted(texts(docs).items()):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(b[p : p + 100])
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()), i
    assert suffix_dedup.remove_repeats(docs).count() == docs.count() and suffix_dedup.remove_repeats(empty).count() == 0


def thue_morse(rounds):
    """A text of a and b that sums of powers modulo 2**64 cannot tell from its complement, and the complement."""
    t = "a"
    for _ in range(rounds):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_span_hash():
    """Spans of any length and place; equal numbers for equal bytes only, also if all hashes are equal."""
    t, u = thue_morse(13)
    buf = np.frombuffer((t + u + t + "x" * 200_000 + "x" * 200_000).encode(), np.uint8)
    n = len(t)
    starts = np.asarray([0, n, 2 * n, 3 * n, 3 * n + 200_000, 3 * n + 1, 5])
    ends = np.asarray([n, 2 * n, 3 * n, 3 * n + 200_000, 3 * n + 400_000, 3 * n + 200_000, 5])
    h = _common.SpanHash()(buf, starts, ends)
    assert h[0] == h[2] != h[1] and h[3] == h[4] != h[5] and len(set(h.tolist())) == 5
    for hasher in (_common.SpanHash(), lambda b, x, y: np.zeros(len(x), np.uint64)):
        ids = _common.span_ids(buf, starts, ends, hasher)
        assert len(set(ids.tolist())) == 5 and ids[0] == ids[2] and ids[3] == ids[4]


def test_long_words_and_lines(spark):
    for rounds in (10, 12, 13):
        t, u = thue_morse(rounds)
        df = spark.createDataFrame([(1, f"{t}\n{u}"), (2, f"{t} {u} {t}\n{t} {u} {t}"), (None, u)], "doc_id long, text string")
        got = {r.doc_id: (r.n_words, r.n_dup_lines, r.n_repeat_words) for r in quality.score(df).collect()}
        assert got == {1: (2, 0, 0), 2: (6, 1, 6), None: (1, 0, 0)}
        bench = spark.createDataFrame([(7, t)], "item_id long, text string")
        assert {r.doc_id: r.n_hit for r in decontamination.decontaminate(df, bench).collect()} == {1: 1, 2: 4, None: 0}


def test_suffix_dedup_awkward(spark):
    """Partitions of short texts alone; rows without doc_id; different texts under one id."""
    short = spark.createDataFrame([(1, "short text"), (2, "x"), (3, None), (4, "")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.remove_repeats(short).collect()) == [(1, 0), (2, 0), (3, 0), (4, 0)]
    r = np.random.default_rng(7)
    a, b, c = ("".join(map(chr, r.integers(97, 123, 150))) for _ in range(3))
    rows = [(None, a), (None, b), (None, a), (3, a + b), (9, c), (9, "zz" + c), (9, c)]
    got = sorted(((r.doc_id or 0), r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got[:4] == [(0, 150, 0), (0, 150, 0), (0, 150, 0), (3, 300, 300)]
    nine = got[4:]
    assert [x[:2] for x in nine] == [(9, 150), (9, 150), (9, 152)] and sorted(x[2] for x in nine) in ([0, 0, 150], [0, 150, 150])


def test_suffix_order_in_files(monkeypatch):
    """Columns in sequential files give the same order as columns in memory."""
    r = np.random.default_rng(3)
    sizes = r.integers(0, 120, 60)
    buf = r.integers(97, 99, int(sizes.sum())).astype(np.uint8)
    want = suffix_dedup.extend(buf, np.cumsum(sizes), sizes)
    monkeypatch.setattr(suffix_dedup, "SPILL_BYTES", 64)
    assert isinstance(suffix_dedup._column(100, np.int64), np.memmap)
    got = suffix_dedup.extend(buf, np.cumsum(sizes), sizes)
    assert all((x == y).all() for x, y in zip(want, got, strict=True))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abc", max_size=15), min_size=1, max_size=8))
def test_suffix_order(strings):
    raw = [s.encode() for s in strings]
    sizes = np.asarray([len(r) for r in raw], np.int64)
    string, size, common = suffix_dedup.extend(np.frombuffer(b"".join(raw), np.uint8), np.cumsum(sizes), sizes)
    want = sorted(((r[len(r) - k :], i) for i, r in enumerate(raw) for k in range(len(r) + 1)), key=lambda x: ([*(c + 1 for c in x[0]), 0], x[1]))
    assert [(raw[i][len(raw[i]) - k :], i) for i, k in zip(string.tolist(), size.tolist(), strict=True)] == want
    for j in range(1, len(want)):
        a, b = want[j - 1][0], want[j][0]
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        assert common[j] == n


def test_language(spark, docs, empty):
    model = language_id.fit(docs)
    got = by_id(language_id.identify(docs, model))
    assert got[1000].lang_pred == got[1001].lang_pred == got[1004].lang_pred == "und" and got[1000].score == 0
    lang = {r.doc_id: r.lang for r in docs.collect() if r.doc_id < 1000}
    assert np.mean([got[i].lang_pred == k for i, k in lang.items()]) > 0.95
    assert language_id.fit(empty) is None and language_id.identify(docs, None).filter("lang_pred <> 'und'").count() == 0
    assert language_id.identify(empty, model).count() == 0


def test_training_sample_is_bounded(spark, monkeypatch):
    """A row given thousands of times takes one place of the sample, and texts one budget of bytes."""
    rows = [(7, "once and again", "en")] * 3000 + [(k, "word " * k, "en" if k % 2 else "de") for k in range(10, 40)] + [(8, "x" * 5000, "de"), (7, "a second text", "en")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    ids = _common.bounded_sample(table, "lang", 20, 10)
    assert ids.count() == 20
    every = table.select("doc_id").distinct()
    got = _common.sampled_rows(table, every)
    assert len(got) == 32 and next(r for r in got if r["doc_id"] == 7)["text"] == "a second text"
    monkeypatch.setattr(_common, "SAMPLE_BYTES", 1000)
    got = _common.sampled_rows(table, every)
    assert 8 not in {r["doc_id"] for r in got} and 900 < sum(len(r["text"]) for r in got) <= 1000
    assert language_id.fit(table) is not None


def test_language_held_out(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.op2_language_id(spark, "/root/testdata/sf0.01").join(table.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(out) > 200 and np.mean([r.lang == r.lang_pred for r in out]) > 0.97


def test_language_kernel():
    """The folded weights against the kernel itself: landmarks, Nystroem ridge regression and scores in plain Python."""
    some = [("the cat sat on the mat", "en"), ("a dog ran to the house", "en"), ("der Hund lief in das Haus", "de"), ("die Katze sass auf der Matte", "de"), ("le chat dort dans la maison", "fr")]
    model = language_id.Model([t.encode() for t, _ in some], [k for _, k in some], landmarks=4)
    spectrum = lambda t: {tuple(language_id.FOLD[np.frombuffer(t.encode(), np.uint8)][i : i + n].tolist()) for n in (1, 2, 3) for i in range(len(t.encode()) - n + 1)}
    kernel = lambda a, b: len(spectrum(a) & spectrum(b)) / (len(spectrum(a)) * len(spectrum(b))) ** 0.5
    names = ["de", "en", "fr"]
    marks = [some[i][0] for i in (2, 0, 4, 3)]  # by turns, languages in order
    k_nm = np.asarray([[kernel(t, m) for m in marks] for t, _ in some])
    k_mm = np.asarray([[kernel(a, m) for m in marks] for a in marks])
    weight = np.asarray([1 / sum(k == j for _, j in some) / 3 for _, k in some])
    target = np.asarray([[1.0 if k == n else -1.0 for n in names] for _, k in some])
    alpha = np.linalg.solve(k_nm.T @ (k_nm * weight[:, None]) + language_id.RIDGE * k_mm / 4 + 1e-9 * np.eye(4), k_nm.T @ (target * weight[:, None]))
    probes = ["the mat in the house", "das Haus und die Katze", "la maison", "xyz"]
    (block,) = blocks([pa.record_batch([pa.array(range(4)), pa.array(probes)], names=["doc_id", "text"])])
    got, scores = model.predict(block)
    for k, text in enumerate(probes):
        margins = np.asarray([kernel(text, m) for m in marks]) @ alpha
        top = np.sort(margins)[::-1]
        assert got[k] == names[int(margins.argmax())] and abs(scores[k] - np.clip((top[0] - max(top[1], -1)) / 2, 0, 1)) < 1e-4


def test_toxicity_tokens():
    assert toxicity.tokens("“ÉCOLE” — it's DON'T 12 Ünï… İx".encode()) == [w.encode() for w in ("école", "it's", "don't", "ünï", "İx")]
    assert len(toxicity.folded("“İ—x".encode()).decode()) == 4


def test_toxicity_held_out(spark, docs, empty):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    out = toxicity.op3_toxicity(spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").collect()
    clean, bad = [r for r in out if not r.toxic], [r for r in out if r.toxic]
    assert np.mean([r.predicted for r in clean]) < 0.02 and np.mean([r.predicted for r in bad]) > 0.8
    assert all(0 <= r.score <= 1 for r in out)
    assert toxicity.fit(docs, labels.limit(0)) is None
    assert toxicity.tag(docs, None).filter("score > 0").count() == 0 and toxicity.tag(empty, None).count() == 0


def test_toxicity_short_and_late():
    """Documents of few words, and offending words behind many others, train the chain."""
    r = np.random.default_rng(6)
    filler = [f"w{c}{d}" for c in "abcdefgh" for d in "ijklmnop"]
    some = lambda n: [filler[i] for i in r.integers(0, len(filler), n)]
    bad = np.arange(400) % 2 == 0
    short = [" ".join([*some(5), "grobnik", *some(3)] if t else some(9)).encode() for t in bad]
    model = toxicity.train(iter(short), bad)
    index = model.index[b"grobnik"]
    assert model.emit[0][index] > 1  # learnt, not only counted
    probe = [model.encode(toxicity.tokens(t.encode())) for t in ("wai grobnik wbj", "wai wck wbj")]
    assert (model.score(model.tag(probe)) > 0.5).tolist() == [True, False]
    marks = np.zeros(500, dtype=bool)
    marks[[0, 3, 7, 30, 31, 90, 200, 201, 350, 499]] = True
    for n in (500, 60, 22, 21, 9, 1, 0):
        codes = np.arange(n, dtype=np.int32)
        got = toxicity.windows(codes, marks[:n], 123)
        assert got.shape[1] == 2 * toxicity.WINDOW + 1
        for m in np.flatnonzero(marks[:n]):
            assert any({max(m - 1, 0), m, min(m + 1, n - 1)} <= set(w[w >= 0].tolist()) for w in got)


@pytest.mark.parametrize(("bad", "good", "least"), [(3000, 3000, 16), (400, 4000, 4)])
def test_rare_seed_words(bad, good, least):
    """A word of no clean document is a seed from a small share of the toxic ones on; common and clean words are none."""
    toxic = np.arange(bad + good) < bad
    lexicon = [b"all", b"enough", b"few", b"half", b"clean"]
    member = [np.ones(len(toxic), bool), np.arange(len(toxic)) < least, np.arange(len(toxic)) < least - 1, np.arange(len(toxic)) % 2 == 0, np.arange(len(toxic)) >= len(toxic) - 50]
    rows = [np.flatnonzero(m).astype(np.int32) for m in np.stack(member, 1)]
    assert toxicity.seed_words(lexicon, rows, toxic)[0] == [b"enough"]


def test_chain_gradients():
    """Gradients over windows of unequal length against differences of the likelihood, by brute force."""
    from itertools import product

    model = toxicity.ChainModel([b"a", b"b"], [])
    r = np.random.default_rng(2)
    model.emit, model.trans, model.bias = r.normal(size=(3, 3)), r.normal(size=(2, 2)), 0.3
    x = np.asarray([[1, 2, 0, 1], [2, 1, -1, -1], [1, -1, -1, -1]], np.int32)
    y = np.asarray([[0, 1, 1, 0], [1, 0, 0, 0], [1, 0, 0, 0]], np.int8)

    def likelihood():
        total = 0.0
        for row, tags in zip(x, y, strict=True):
            n = int((row >= 0).sum())
            u = model.unary(row[None, :n])[0]
            weigh = lambda t: sum(u[k] * t[k] for k in range(n)) + sum(model.trans[t[k], t[k + 1]] for k in range(n - 1))
            total += weigh(tags) - np.log(sum(np.exp(weigh(t)) for t in product((0, 1), repeat=n)))
        return total

    got = model.gradients(x, y)
    for values, grad in ((model.emit, got[0]), (model.trans, got[2])):
        for i in np.ndindex(values.shape):
            values[i] += 1e-5
            up = likelihood()
            values[i] -= 2e-5
            low = likelihood()
            values[i] += 1e-5
            assert abs((up - low) / 2e-5 - grad[i]) < 1e-5


def test_chain_marginals():
    """Forward-backward against the sum over all taggings."""
    rng = np.random.default_rng(1)
    model = toxicity.ChainModel([b"a", b"b", b"c"], [])
    model.emit, model.trans, model.bias = rng.normal(size=(3, 4)), rng.normal(size=(2, 2)), 0.3
    for n in (1, 2, 5):
        x = rng.integers(0, 4, n)
        u = model.unary(x[None])[0]
        total, ones = 0.0, np.zeros(n)
        for m in range(2**n):
            y = [(m >> k) & 1 for k in range(n)]
            p = np.exp(sum(u[k] * y[k] for k in range(n)) + sum(model.trans[y[k], y[k + 1]] for k in range(n - 1)))
            total += p
            ones += p * np.asarray(y)
        assert np.allclose(model.tag([x])[0], ones / total)


def test_license(spark, empty):
    t = license_scan.TEMPLATES
    cases = {1: "x y z. " + t["MIT"] + " more", 2: "we say: " + t["GPL-3.0"].upper().replace("VERSION 3", "version 2"), 3: "no licence here at all, nothing", 4: None, 5: "", 6: ("filler words " * 5000) + t["BSD-grant"] + " " + t["Apache-2.0"], 7: "Released under the BSD License."}
    df = spark.createDataFrame([(k, v, 0) for k, v in cases.items()], "doc_id long, text string, licenses int")
    got = by_id(license_scan.scan(df))
    assert {k: r.licenses for k, r in got.items()} == {1: "MIT", 2: "GPL-3.0", 3: "", 4: "", 5: "", 6: "Apache-2.0,BSD-grant", 7: ""}
    m = got[1].matches[0]
    assert cases[1][m.start : m.end] == "Released under the MIT License"
    assert license_scan.scan(empty).count() == 0


def test_license_texts_and_notices(spark):
    """The query's own set: full texts (some words changed, a copyright line before), headers and notices, each under its own name alone."""
    known = license_scan.licenses()
    cases = {}
    for file in sorted(license_scan.TEXTS.glob("*.txt")):
        text = file.read_text().split()
        cases["Copyright 2020 A. Body " + " ".join("zzz" if i % 50 == 7 else w for i, w in enumerate(text)) + " and more"] = file.stem
    for name in ("Apache-2.0", "MPL-2.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "AGPL-3.0"):
        cases["x " + license_scan.NOTICES[name][0] + " y"] = name
    for v in "123":
        cases[f"This work is licensed under the GNU General Public License, version {v}."] = f"GPL-{v}.0"
    cases |= {"// SPDX-License-Identifier: MIT": "MIT", "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause", "# SPDX-License-Identifier: LGPL-2.1-or-later": "LGPL-2.1", "SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0,MIT"}
    cases |= {"This project is licensed under the MIT License - see LICENSE": "MIT", "distributed under the 3-Clause BSD License": "BSD-3-Clause", "Text under a Creative Commons Attribution-ShareAlike 4.0 International License.": "CC-BY-SA-4.0", "Released under the BSD License.": "", "Licensed under CC BY 4.0": "CC-BY-4.0"}
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    got = by_id(license_scan.scan(df, known))
    assert [got[i].licenses for i in range(len(cases))] == list(cases.values())
    assert min(r.n_matches for i, r in got.items() if list(cases.values())[i]) == 1


def test_tokens_and_output(spark, docs, empty, tmp_path):
    encode = WordEncoder().tokenizer.encode
    folder = f"file://{tmp_path}/shards"
    manifest = token_output.write(docs, folder, shards=3)
    got = sorted(token_output.read_back(manifest).collect(), key=lambda r: r.start)
    want = sorted(docs.select("doc_id", "text").collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [r.doc_id for r in want]
    own, at = texts(docs), 0
    for r in got:
        ids = [*encode(own[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(np.asarray(ids, "<u4")))
        at += len(ids)
    assert token_output.read_back(token_output.write(empty, folder + "-none")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abXY éÉßñ.,!'s%&*\t\n\r\x0b\x1c\x85́Σ中<|>endoftxt12٣\U0001f600"))), max_size=4))
def test_word_encoding(rows):
    global _ENCODER
    _ENCODER = globals().get("_ENCODER") or WordEncoder()
    rows = [*rows, "<|endoftext|> <|ENDOFTEXT|>"]
    (block,) = blocks([pa.record_batch([pa.array(range(len(rows))), pa.array(rows)], names=["doc_id", "text"])])
    ids, counts = _ENCODER(block, 7)
    want = [[*_ENCODER.tokenizer.encode(t, add_special_tokens=False).ids, 7] for t in rows]
    assert ids.tolist() == [i for w in want for i in w] and counts.tolist() == [len(w) for w in want]


def test_word_encoding_together():
    """Plain words, accented ones included, keep the shared encoding; ids that do not add up to a word's bytes fall back."""
    encode = WordEncoder()
    plain = ["ouéaieux", "le", "stlich", "größe", "naïve.", "x!!"]
    ids, counts = encode._together(plain, np.asarray([1, 1, 1, 1, 2, 2]))
    assert counts.sum() == len(ids) > 0
    alone = [encode.tokenizer.encode(w, add_special_tokens=False).ids for w in plain]
    assert ids.tolist() == [i for x in alone for i in x] and counts.tolist() == [*map(len, alone)]
    encode.n_bytes[ids[0]] += 1
    assert not len(encode._together(plain, np.asarray([1, 1, 1, 1, 2, 2]))[0])


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_packing_plan(histogram):
    counts = np.zeros(65, np.int64)
    for k, n in histogram.items():
        counts[k] = n
    chosen, _ = packing.plan(counts, 64)
    used = np.zeros(65, np.int64)
    for pattern, times in chosen:
        assert sum(pattern) <= 64 and times > 0
        np.add.at(used, list(pattern), times)
    assert (used == counts).all()
    # As few sequences as best fit, longest first, takes piece by piece, but for what filling equal bins together costs.
    rooms: list[int] = []
    for k in range(64, 0, -1):
        for _ in range(int(counts[k])):
            room = min((r for r in rooms if r >= k), default=None)
            if room is not None:
                rooms.remove(room)
            rooms.append((64 if room is None else room) - k)
    assert sum(t for _, t in chosen) <= len(rooms) + 1 + len(rooms) // 50


def test_packing(docs, empty):
    got = packing.pack(docs, capacity=256).collect()
    own = texts(docs)
    by_sequence: dict = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    encode = WordEncoder().tokenizer.encode
    for r in got:
        ids = [*encode(own[r.doc_id], add_special_tokens=False).ids, 1][r.start : r.start + 256]
        assert (r.piece * 256, len(ids), zlib.crc32(np.asarray(ids, "<u4"))) == (r.start, r.length, r.ids_crc32)
    assert len(by_sequence) <= sum(r.length for r in got) / 256 * 1.05 + 1
    assert packing.pack(empty).count() == 0


def test_quality(docs, empty):
    got = by_id(quality.score(docs))
    for i, t in texts(docs).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        c = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {k + j for k in range(len(w) - 2) if c[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed), i
        assert not (failed and r.kept)
    assert quality.score(empty).count() == 0


def brute_links(own):
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := words(t)) else set() for i, t in own.items()}
    ids = sorted(sets)
    links = {i: set() for i in ids}
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 9 * both >= 4 * (len(sets[i]) + len(sets[j])):
                links[i].add(j)
                links[j].add(i)
    root = {}
    for i in ids:
        if i not in root:
            stack = [i]
            while stack:
                k = stack.pop()
                if k not in root:
                    root[k] = i
                    stack += links[k]
    return links, root


@pytest.mark.parametrize("dense", [1.0, 0.0])
def test_jaccard_join(docs, empty, dense, monkeypatch):
    """Against all pairs; by ties, and along the groups of each tree alone."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    monkeypatch.setattr(jaccard_join, "DENSE", dense)
    once = docs.dropDuplicates(["doc_id"])
    got = by_id(jaccard_join.similarity_classes(once))
    links, root = brute_links(texts(once))
    assert {i: (r.class_id, r.n_links) for i, r in got.items()} == {i: (root[i], len(links[i])) for i in root}
    if dense:
        assert jaccard_join.similarity_classes(docs).count() == docs.count() and jaccard_join.similarity_classes(empty).count() == 0


def test_jaccard_filter(spark, monkeypatch):
    """The filter lets every wanted row through, null ids too, however full it is."""
    rows = spark.range(3000).selectExpr("if(id = 7, null, id) AS doc_id", "xxhash64(id) AS text_key")
    wanted = rows.filter("doc_id IS NULL OR doc_id % 10 = 3").toDF("id", "key")
    for size, most in ((1 << 25, 310), (64, 3000)):
        monkeypatch.setattr(jaccard_join, "FILTER_BITS", size)
        got = {r["doc_id"] for r in jaccard_join._marked(rows, wanted).collect()}
        assert {None, *range(3, 3000, 10)} <= got and len(got) <= most


def test_jaccard_join_by_row(spark):
    """Rows without doc_id, different texts under one id, and equal rows are rows of their own."""
    r = np.random.default_rng(4)
    base = [f"w{k}" for k in r.integers(0, 5000, 200)]
    near = [*base[:-3], "x", "y", "z"]
    other = [f"v{k}" for k in r.integers(0, 5000, 50)]
    rows = [(None, " ".join(base), 1), (None, " ".join(base), 2), (2, " ".join(near), 3), (3, "alone " + " ".join(other), 4), (9, " ".join(near), 5), (9, "quite " + " ".join(f"u{k}" for k in range(40)), 6), (5, " ".join(f"t{k}" for k in range(30)), 7), (5, " ".join(f"t{k}" for k in range(30)), 8), (None, None, 9), (None, " ".join(f"s{k}" for k in range(30)), 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _salt int")
    got = sorted((r.doc_id or 0, r.class_id or 0, r.rep_id or 0, r.n_links) for r in jaccard_join.similarity_classes(df).collect())
    assert got == sorted([(0, 2, 0, 3), (0, 2, 0, 3), (2, 2, 2, 3), (3, 3, 3, 0), (9, 2, 2, 3), (9, 9, 9, 0), (5, 5, 5, 1), (5, 5, 5, 1), (0, 0, 0, 0), (0, 0, 0, 0)])
    kept = [r["_salt"] for r in jaccard_join.keep_one(df).collect()]
    assert sorted(kept) in ([3, 4, 6, 7, 9, 10], [3, 4, 6, 8, 9, 10])


def test_skew_join(spark):
    rows = spark.range(3000).selectExpr("id % 7 AS k", "id").union(spark.range(5000, 9000).selectExpr("3 AS k", "id"))
    got = _common.skew_join(rows, rows.groupBy("k").count().selectExpr("k", "count AS n"), ["k"])
    n = rows.groupBy("k").count().rdd.collectAsMap()
    assert sorted((r.k, r.id, r.n) for r in got.collect()) == sorted((r.k, r.id, n[r.k]) for r in rows.collect())


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {n: n for e in edges for n in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_preferences(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "good"), (2, 0, "user", None), (4, 0, None, "x"), (4, 0, "user", "a"), (None, 0, "user", "q")]
    other = [(1, 0, "user", "hi"), (1, 1, "assistant", "bad\nday"), (1, 2, "user", "why"), (2, 0, "user", ""), (3, 0, "user", "alone")]
    make = lambda r: spark.createDataFrame(r, "pair_id long, turn long, role string, text string")
    got = {r.pair_id: r for r in preferences.format_pairs(make(rows), make(other)).collect()}
    a = got[1]
    assert (a.n_prefix, a.prompt, a.chosen) == (1, "<|user|>\nhi\n", "<|assistant|>\ngood\n")
    assert [a.rejected[slice(*map(int, s.split(":")))] for s in a.rejected_spans.split(",")] == ["bad\nday\n"]
    assert (got[2].n_prefix, got[2].chosen, got[2].rejected) == (1, "", "") and (got[3].chosen, got[3].prompt) == (None, "")
    assert got[4].rejected is None and set(got) == {1, 2, 3, 4}
    assert preferences.format_pairs(make([]), make([])).count() == 0


def test_decontamination(spark, docs, empty):
    own = texts(docs)
    long_words = words(own[sorted(own)[3]])
    items = [(1, " ".join(long_words[5:30])), (2, "again and again"), (3, None), (4, ""), (5, "a"), (1, " ".join(long_words[5:20])), (6, "words nobody has written anywhere in these texts"), (7, "日本語のテキスト" * 30)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows: dict = {}
    for i, t in items:
        w = words(t or "")
        for k in range(max(1, len(w) - 7) if w else 0):
            windows.setdefault(tuple(w[k : k + 8]), set()).add(str(i))
    for block_words in (200_000, 5):
        got = by_id(decontamination.decontaminate(docs, bench, block_words=block_words))
        for i, t in own.items():
            w, hit, found = words(t), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if x := windows.get(tuple(w[k : k + n])):
                        hit |= set(range(k, k + n))
                        found |= x
            r = got[i]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2)
    assert decontamination.decontaminate(empty, bench).count() == 0 and decontamination.decontaminate(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_fm_index(symbols):
    text = np.asarray([*symbols, 0])
    index = decontamination.FMIndex(text, 3)
    for n in (1, 2, 3):
        patterns = np.asarray([p for p in np.ndindex(*(3,) * n)]) + 1
        lo, hi = index.search(patterns, np.full(len(patterns), n))
        for p, a, b in zip(patterns, lo, hi, strict=True):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [k for k in range(len(text) - n + 1) if (text[k : k + n] == p).all()]


def test_pipeline(spark, docs, empty):
    import corpus_pipeline as P

    at, before = docs.dropDuplicates(["doc_id"]), texts(docs)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, at, SF)
        assert out.columns == docs.columns, name
        rows = {r.doc_id: r for r in out.collect()}
        if name == "language_id":
            assert set(before) - set(rows) >= {1000, 1001, 1003, 1004}
        if name == "near_duplicates":
            _, root = brute_links(before)
            assert set(rows) == set(root.values())
        if name in ("repeated_passages", "decontamination"):
            assert set(rows) == set(before)
            assert all(r.n_chars == len(r.text) for i, r in rows.items() if r.text != before[i])
        before = {i: r.text or "" for i, r in rows.items()}
        at = spark.createDataFrame(list(rows.values()), docs.schema)
        assert stage(spark, empty, SF).count() == 0
    assert {r.doc_id for r in P.STAGES[-1][1](spark, at, SF).collect()} == set(before)
    assert P.run(spark, SF).count() > 50


def test_checkpoint_cuts_lineage_and_leaves_the_setting(spark):
    before = spark.conf.get(_common._CLEANUP, None)
    counts = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = _common.checkpoint(counts)
    again = _common.checkpoint(kept.join(counts.withColumnRenamed("count", "n"), "k"))
    # The frame that was cut, its source and what joins both can all be read more than once.
    for _ in range(2):
        assert kept.agg(F.sum("count")).first()[0] == counts.agg(F.sum("count")).first()[0] == 1000
        assert again.filter("count = n").count() == 7
    assert "Exchange" not in kept._jdf.queryExecution().executedPlan().toString()
    assert spark.conf.get(_common._CLEANUP, None) == before
    assert _common.checkpoint(spark.createDataFrame([], "a long, b long")).count() == 0
