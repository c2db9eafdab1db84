"""License scans: MinHash bands over overlapping windows, then exact shingle containment.

Templates and texts are sequences of 5-word shingles (lower-cased words); a
template of 4 words is one shingle of 4.  Templates of like length form a class
with one window length and stride, such that any whole occurrence lies in some
window; a row's last windows end with it.  A window that has fewer shingles of
a class than the least containment asks for cannot match and is passed over.
Each other window and each template has ``BANDS`` keys of ``ROWS`` minima; a
window whose key equals a template's in some band retrieves it.
``collision_probability`` bounds from below the chance that a window holding an
occurrence at the least containment is retrieved; classes and bands are such
that it is at least 0.9999.  A retrieved window counts if it has at least
``CONTAINMENT`` of the template's distinct shingles, exactly.

A license may have several templates (``licenses``: full text, headers, notice
wordings).  Of templates of different licenses that resemble each other -- the
one has ``CONTAINMENT`` of the other's shingles, as versions of one notice do
-- the one of which most words are found stands for a place, and of equals the
more complete; equals in both stand together.  Matches of one license that
overlap are merged; a span runs from the first to the last matching shingle.

Edge cases: null texts and texts of fewer words than any template match nothing;
repeated rows are scanned each by itself; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Block, SpanHash, blocks, mix, ragged, table
from .decontamination import LOWER, words

WORDS = 5
LEAST_WORDS = 4
CONTAINMENT = (4, 5)
BANDS = 30
ROWS = 2
#: Public license notices by SPDX-like name, the default of ``scan``; ``licenses`` has them and many more.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
}

#: Full texts by SPDX name, a file each.
TEXTS = Path(__file__).with_name("licenses")
#: How notices name a license, by SPDX name; ``licenses`` puts leads before each.
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License"],
    "Zlib": ["zlib License"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0"],
    "Unlicense": ["Unlicense"],
    "0BSD": ["Zero-Clause BSD License", "BSD Zero Clause License", "0BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License", "BSD-2-Clause License", "FreeBSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License", "revised BSD License"],
    "BSD-4-Clause": ["BSD 4-Clause License", "4-Clause BSD License", "original BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2.0", "Apache-2.0 License", "Apache Software License, Version 2.0", "Apache License, v. 2.0"],
    "MPL-1.1": ["Mozilla Public License, Version 1.1", "Mozilla Public License 1.1", "Mozilla Public License, v. 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License, v. 2.0", "MPL 2.0"],
    "EPL-1.0": ["Eclipse Public License, Version 1.0", "Eclipse Public License 1.0", "Eclipse Public License v1.0"],
    "EPL-2.0": ["Eclipse Public License, Version 2.0", "Eclipse Public License 2.0", "Eclipse Public License v2.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "Creative Commons Zero v1.0 Universal", "Creative Commons CC0 1.0 Universal"],
    "Artistic-1.0": ["Artistic License 1.0", "Artistic License, Version 1.0"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, Version 2.0"],
}
_GNU = {"GPL": ("GNU General Public License", "123"), "LGPL": ("GNU Lesser General Public License", "2.1 3"), "AGPL": ("GNU Affero General Public License", "3"), "GFDL": ("GNU Free Documentation License", "1.2 1.3")}
for _short, (_long, _versions) in _GNU.items():
    for _v in _versions.split() if "." in _versions else _versions:
        _full = _v if "." in _v else f"{_v}.0"
        NAMES[f"{_short}-{_full}"] = [f"{long}{x}" for long in (_long, _long.removeprefix("GNU "), _short, f"GNU {_short}") for v in sorted({_v, _full}) for x in (f", version {v}", f" v{v}", f" {v}")]
NAMES["LGPL-2.0"] = ["GNU Library General Public License, version 2", "GNU Library General Public License v2", "LGPL, version 2.0", "LGPL v2.0", "LGPL 2.0"]
for _kind, _long in {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}.items():
    for _v, _where in {"2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}.items():
        NAMES[f"CC-{_kind}-{_v}"] = [f"CC {_kind} {_v}", f"Creative Commons {_kind} {_v}", f"Creative Commons {_long} {_v} {_where}", f"Creative Commons {_long} {_v}", f"Creative Commons {_long} License {_v}"]
#: What a notice says before the name: before a name of three words or more, which tells by itself, and before a shorter one.
LEADS = ["under the", "under a", "under", "terms of the"]
SHORT_LEADS = [f"{verb} under{the}" for verb in ("licensed", "released", "distributed", "available", "published", "provided") for the in (" the", " a", "")] + ["under the terms of the", "under the terms and conditions of the", "subject to the terms of the"]
_GNU_HEADER = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{which}"
#: Standard headers and notices with words of their own, by SPDX name.
NOTICES = {
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "MPL-1.1": ['The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/'],
    "EPL-1.0": ["All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"],
    "EPL-2.0": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0"],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"],
    "MIT": ["Use of this source code is governed by an MIT-style license that can be found in the LICENSE file"],
    "GFDL-1.2": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.2 or any later version published by the Free Software Foundation"],
    "GFDL-1.3": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"],
}
for _name, _long, _v in (("GPL-1.0", "General Public License", "1"), ("GPL-2.0", "General Public License", "2"), ("GPL-3.0", "General Public License", "3"), ("LGPL-2.0", "Library General Public License", "2"), ("LGPL-2.1", "Lesser General Public License", "2.1"), ("LGPL-3.0", "Lesser General Public License", "3"), ("AGPL-3.0", "Affero General Public License", "3")):
    NOTICES[_name] = [_GNU_HEADER.format(name=_long, which=w) for w in (f"; either version {_v} of the License, or (at your option) any later version", f"; version {_v} of the License", f", version {_v}")] + [f"This work is licensed under the GNU {_long}, version {_v}."]
#: Names of SPDX-License-Identifier lines, where they are not the license's own name.
SPDX = {n: [f"{n}-only", f"{n}-or-later", n, f"{n}+"] for n in NAMES if n.startswith(("GPL-", "LGPL-", "AGPL-", "GFDL-"))} | {"MIT": ["MIT", "MIT OR Apache-2.0", "Apache-2.0 OR MIT"], "Apache-2.0": ["Apache-2.0", "MIT OR Apache-2.0", "Apache-2.0 OR MIT"]}


@cache
def licenses() -> dict[str, list[str]]:
    """The query's templates by license: the notices of ``TEMPLATES``, full texts, standard headers, and usual wordings and SPDX lines by version."""
    out: dict[str, list[str]] = {name: [text] for name, text in TEMPLATES.items()}
    for file in sorted(TEXTS.glob("*.txt")):
        out.setdefault(file.stem, []).append(file.read_text())
    for name in sorted({*NAMES, *NOTICES, *out} - {n for n in out if n.endswith("-grant")}):
        own = out.setdefault(name, [])
        own += NOTICES.get(name, [])
        own += [f"SPDX-License-Identifier: {x}" for x in SPDX.get(name, [name])]
        for x in NAMES.get(name, []):
            leads = LEADS if len(_WORD.findall(x)) >= 3 else SHORT_LEADS
            own += [w for lead in leads if len(_WORD.findall(w := f"{lead} {x}")) >= LEAST_WORDS]
    return out


_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_MULTIPLIERS = np.random.default_rng(4).integers(1, 1 << 62, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0xE7037ED1A0B428DB)
_BAND_STEPS = np.arange(BANDS, dtype=np.uint64) * _STEP
#: A chunk of windows to sign holds so many shingles at most (one longer window makes a chunk of its own).
CHUNK = 1 << 18


def collision_probability(shingles: int, window: int, bands: int = BANDS, rows: int = ROWS) -> float:
    """The chance, at least, that a window of so many shingles with the least containment of a template meets it in a band."""
    common = -(-CONTAINMENT[0] * shingles // CONTAINMENT[1])
    similarity = common / (window + shingles - common)
    return 1 - (1 - similarity**rows) ** bands


def _shingles(starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash, first byte and end byte of every shingle of n words."""
    size = max(len(starts) - n + 1, 0)
    key = np.zeros(size, np.uint64)
    for k in range(n):
        key = key * _STEP + hashes[k : k + size]
    whole = row[:size] == row[n - 1 :] if size else np.zeros(0, bool)
    return row[:size][whole], mix(key[whole]), starts[:size][whole], ends[n - 1 :][whole] if size else ends[:0]


@dataclass
class _Class:
    words: int  # of a shingle
    window: int
    stride: int
    least: int  # shingles that a window has at least if it matches
    known: np.ndarray  # all shingles of its templates, sorted
    keys: np.ndarray  # the band keys of all of them, sorted, and
    owners: np.ndarray  # whose they are


@dataclass
class Templates:
    names: list[str]
    sets: list[np.ndarray]
    words: list[int]
    rivals: set[tuple[int, int]]  # of different licenses, resembling each other
    classes: list[_Class]


def _minima(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The band keys of runs of shingles that begin at cuts; keys of different bands differ."""
    out = np.empty((len(cuts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.zeros(len(cuts), np.uint64)
        for m in _MULTIPLIERS[band * ROWS : (band + 1) * ROWS]:
            key = (key << np.uint64(32)) | np.minimum.reduceat((values * m) >> np.uint64(32), cuts)
        out[:, band] = mix(key + _BAND_STEPS[band])
    return out


def _rivals(names: list[str], texts: list[list[bytes]]) -> set[tuple[int, int]]:
    out = set()
    for n in (WORDS, LEAST_WORDS):
        sets = [{tuple(t[i : i + n]) for i in range(len(t) - n + 1)} for t in texts]
        holders: dict[tuple, list[int]] = {}
        for i, own in enumerate(sets):
            for x in own:
                holders.setdefault(x, []).append(i)
        common: Counter = Counter()
        for held in holders.values():
            common.update((i, j) for i, j in combinations(held, 2) if names[i] != names[j])
        for (i, j), k in common.items():
            if CONTAINMENT[1] * k >= CONTAINMENT[0] * min(len(sets[i]), len(sets[j])) and (n == WORDS or min(len(texts[i]), len(texts[j])) < WORDS):
                out |= {(i, j), (j, i)}
    return out


def classes(templates: dict[str, str | list[str]]) -> Templates:
    hasher = SpanHash()
    names: list[str] = []
    texts: list[list[bytes]] = []
    seen = set()
    made = Templates([], [], [], set(), [])
    by = []
    for name, own in templates.items():
        for text in [own] if isinstance(own, str) else own:
            buf = LOWER[np.frombuffer(text.encode(), np.uint8)]
            starts, ends, hashes = words(buf, np.asarray([0, len(buf)]), hasher)
            if len(starts) < LEAST_WORDS:
                raise ValueError(f"template {name} has under {LEAST_WORDS} words")
            n = min(WORDS, len(starts))
            key = _shingles(starts, ends, hashes, np.zeros(len(starts), np.int64), n)[1]
            if (name, key.tobytes()) in seen:
                continue
            seen.add((name, key.tobytes()))
            by.append((n, len(np.unique(key)), len(key), len(names)))
            names.append(name)
            texts.append([buf[a:b].tobytes() for a, b in zip(starts, ends, strict=True)])
            made.sets.append(np.unique(key))
            made.words.append(n)
    made.names, made.rivals = names, _rivals(names, texts)

    def plan(group: list[tuple]) -> tuple[int, int] | None:
        """The window and stride of templates in one class, if they find their templates."""
        stride = max(1, min(n for _, n, _, _ in group) // 5)
        window = max(length for _, _, length, _ in group) + stride - 1
        return (window, stride) if all(collision_probability(n, window) >= 0.9999 for _, n, _, _ in group) else None

    groups: list[list[tuple]] = []
    for item in sorted(by):
        if plan([item]) is None:
            raise ValueError(f"windows of template {names[item[3]]} find it with a chance below 0.9999: it repeats itself too often")
        if groups and groups[-1][0][0] == item[0] and plan([*groups[-1], item]):
            groups[-1].append(item)
        else:
            groups.append([item])
    for group in groups:
        window, stride = plan(group)
        own = [made.sets[t] for _, _, _, t in group]
        sizes = np.asarray([len(k) for k in own])
        keys = _minima(np.concatenate(own), np.cumsum(sizes) - sizes).ravel()
        owners = np.repeat([t for _, _, _, t in group], BANDS)
        order = np.argsort(keys, kind="stable")
        least = -(-CONTAINMENT[0] * group[0][1] // CONTAINMENT[1])
        made.classes.append(_Class(group[0][0], window, stride, least, np.unique(np.concatenate(own)), keys[order], owners[order]))
    return made


def _inside(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _retrieved(c: _Class, key: np.ndarray, begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(first shingle, end shingle, template) of each window that meets a template in a band; begin and end are of each shingle's row."""
    sums = np.concatenate([[0], np.cumsum(_inside(key, c.known))])
    place = np.arange(len(key))
    at = place[(place - begin) % c.stride == 0]
    to = np.minimum(at + c.window, end[at])
    some = sums[to] - sums[at] >= c.least
    at, to = at[some], to[some]
    size = np.cumsum(to - at)
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(size, (size[first - 1] if first else 0) + CHUNK, side="right")))
        a, n = at[first:last], (to - at)[first:last]
        keys = _minima(key[ragged(a, n)], np.cumsum(n) - n)
        low = np.searchsorted(c.keys, keys)
        times = np.searchsorted(c.keys, keys, side="right") - low
        met = np.stack([np.repeat(np.arange(last - first), times.sum(1)), c.owners[ragged(low.ravel(), times.ravel())]], 1)
        for w, t in np.unique(met, axis=0).tolist():
            yield int(a[w]), int(a[w] + n[w]), t
        first = last


def scan_block(block: Block, found: Templates, hasher: SpanHash) -> list[tuple[int, str, int, int]]:
    """(row, license, first byte, end byte) of each match of a block, spans merged."""
    starts, ends, hashes = words(LOWER[block.buf], block.offsets, hasher)
    rows = block.rows_of(starts)
    up, down = CONTAINMENT
    hits: dict[tuple[int, int], list[list]] = {}  # row, template: spans with the shingles found
    for n in sorted({c.words for c in found.classes}):
        row, key, first, last = _shingles(starts, ends, hashes, rows, n)
        own = [c for c in found.classes if c.words == n]
        # Rows without a shingle of any template are passed over.
        known = np.zeros(len(block), dtype=bool)
        known[row[_inside(key, np.unique(np.concatenate([c.known for c in own])))]] = True
        keep = known[row]
        row, key, first, last = row[keep], key[keep], first[keep], last[keep]
        begin, end = np.searchsorted(row, row), np.searchsorted(row, row, side="right")
        for c in own if len(row) else []:
            for a, b, t in _retrieved(c, key, begin, end):
                member = np.flatnonzero(_inside(key[a:b], found.sets[t]))
                count = len(np.unique(key[a:b][member]))
                if down * count >= up * len(found.sets[t]):
                    hits.setdefault((int(row[a]), t), []).append([int(first[a + member[0]]), int(last[a + member[-1]]), count + n - 1])
    places: dict[int, list[tuple[int, int, tuple, int]]] = {}
    for (r, t), spans in hits.items():
        merged: list[list] = []
        for span in sorted(spans):
            if merged and span[0] <= merged[-1][1]:
                merged[-1][1:] = max(span[1], merged[-1][1]), max(span[2], merged[-1][2])
            else:
                merged.append(span)
        total = len(found.sets[t]) + found.words[t] - 1
        places.setdefault(r, []).extend((a, b, (n, -total), t) for a, b, n in merged)
    out = []
    for r in sorted(places):
        spans = sorted(places[r])
        kept = []
        for i, (a, b, worth, t) in enumerate(spans):
            if not any(x < b and a < y and other > worth and (t, u) in found.rivals for x, y, other, u in spans[:i] + spans[i + 1 :]):
                kept.append((found.names[t], a, b))
        for name, a, b in sorted(kept):
            if out and out[-1][:2] == (r, name) and a <= out[-1][3]:
                out[-1] = (r, name, out[-1][2], max(b, out[-1][3]))
            else:
                out.append((r, name, a, b))
    return out


def scan(docs: DataFrame, templates: dict[str, str | list[str]] | None = None) -> DataFrame:
    """Per row: doc_id, n_matches, licenses (sorted names, comma-joined), matches (name, first and end character)."""
    found = classes(templates or TEMPLATES)
    shared = docs.sparkSession.sparkContext.broadcast(found)

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = SpanHash()
        for block in blocks(batches):
            own: list[list[dict]] = [[] for _ in range(len(block))]
            for r, name, a, b in scan_block(block, shared.value, hasher):
                o = int(block.offsets[r])
                lead = len(block.buf[o:a].tobytes().decode())
                own[r].append({"license": name, "start": lead, "end": lead + len(block.buf[a:b].tobytes().decode())})
            own = [sorted(x, key=lambda m: (m["start"], m["license"])) for x in own]
            names = [",".join(sorted({m["license"] for m in x})) for x in own]
            kind = pa.list_(pa.struct({"license": pa.string(), "start": pa.int64(), "end": pa.int64()}))
            yield pa.record_batch([block.ids, pa.array([len(x) for x in own], pa.int64()), pa.array(names), pa.array(own, kind)], names=["doc_id", "n_matches", "licenses", "matches"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(scanned, "doc_id long, n_matches long, licenses string, matches array<struct<license:string,start:long,end:long>>")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), licenses())
