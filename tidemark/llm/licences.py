"""Licence notices found by MinHash bands over overlapping text windows (operator 4).

Words are runs of letters and digits, A-Z lower-cased. A template of m words is found where `SPAN` m words in a row, from
any word on, hold the required share of its five-word shingles; so a notice may have up to (`SPAN` - 1) m words inserted,
wherever it starts. The text is cut into windows of (`SPAN` + 1) m shingles that start every m words, so any such run lies in
one window. Signatures of one-row bands retrieve candidates; the number of bands is chosen for each template length so that a
window with the required containment is missed with a probability below `MISS`. Candidates are verified run by run.

Null text has no words. Templates of fewer than five words are one shingle.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tidemark.llm.common import shingle_hashes, word_hasher, word_hashes

SHINGLE, SPAN, CONTAINED, MISS, CHUNK_WORDS = 5, 3, 0.8, 1e-6, 400_000
WORD = re.compile(rb"[a-z0-9\x80-\xff]+")
#: Public licence notices.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
}


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


def shingle_set(words: list[bytes]) -> set[tuple]:
    k = min(SHINGLE, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if k else set()


def bands_for(m: int, contained: float = CONTAINED, miss: float = MISS) -> int:
    """One-row bands that miss a window of (SPAN + 1) m shingles with the required containment with a probability below `miss`."""
    t, w = max(1, m - SHINGLE + 1), (SPAN + 1) * m
    shared = math.ceil(contained * t - 1e-9)
    like = shared / (w + t - shared)
    return math.ceil(math.log(miss) / math.log1p(-like)) if like < 1 else 1


class Templates:
    """Templates by length in words, with the hash minima of their shingles."""

    def __init__(self, templates: dict[str, str], contained: float):
        self.contained, hasher = contained, word_hasher()
        self.sets = {name: shingle_set(words_of(t)) for name, t in sorted(templates.items())}
        self.lengths = {name: len(words_of(t)) for name, t in templates.items()}
        by: dict[int, list[str]] = {}
        for name, t in sorted(templates.items()):
            if words_of(t):
                by.setdefault(len(words_of(t)), []).append(name)
        rng = np.random.default_rng(11)
        self.groups = []
        for m, names in sorted(by.items()):
            k = bands_for(m, contained)
            mul = rng.integers(0, 2 ** 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
            add = rng.integers(0, 2 ** 32, k, dtype=np.uint32)
            short = {n: (shingle_hashes(word_hashes(words_of(templates[n]), hasher), SHINGLE) >> np.uint64(32)).astype(np.uint32) for n in names}
            low = {n: [(short[n] * a + b).min() for a, b in zip(mul, add)] for n in names}
            self.groups.append((m, mul, add, low))

    def candidates(self, shingles: np.ndarray, sizes: list[int]):
        """(document, first word, template) of windows that share a band with a template. `sizes`: words per document."""
        have = np.array([max(0, n - SHINGLE + 1) if n >= SHINGLE else min(1, n) for n in sizes], np.int64)
        used = np.flatnonzero(have)
        if not len(used):
            return
        at, short = (np.cumsum(have) - have)[used], (shingles >> np.uint64(32)).astype(np.uint32)
        for m, mul, add, low in self.groups:
            blocks = -(-have[used] // m)  # of m shingles each; a window is SPAN + 1 of them, or the whole text
            ends = np.cumsum(blocks)
            own = np.repeat(np.arange(len(used)), blocks)
            nth = np.arange(ends[-1]) - (ends - blocks)[own]
            # block by column; a short one is filled up with its text's last shingle. 32 bits of a hash: equal minima are verified
            laid = short[np.minimum((at[own] + nth * m)[None, :] + np.arange(m)[:, None], (at + have[used] - 1)[own][None, :])]
            first = np.flatnonzero(nth <= np.maximum(0, blocks - SPAN - 1)[own])
            last = ends[own[first]] - 1
            hit = {n: np.zeros(len(first), bool) for n in low}
            h = np.empty_like(laid)
            for k in range(len(mul)):
                np.multiply(laid, mul[k], out=h)
                h += add[k]
                least = h.min(axis=0)
                mins = least[first]
                for j in range(1, SPAN + 1):
                    np.minimum(mins, least[np.minimum(first + j, last)], out=mins)
                for n in low:
                    hit[n] |= mins == low[n][k]
            for n in low:
                for i in first[np.flatnonzero(hit[n])].tolist():
                    yield int(used[own[i]]), int(nth[i]) * m, n

    def share(self, name: str, words: list[bytes]) -> float:
        """Largest share of the template's shingles in any SPAN m words in a row."""
        want, m, k = self.sets[name], self.lengths[name], min(SHINGLE, len(words))
        known = [(i, x) for i in range(len(words) - k + 1) if (x := tuple(words[i:i + k])) in want]
        held, best, a = Counter(), 0, 0
        for i, x in known:
            held[x] += 1
            while known[a][0] + SPAN * m < i + k:
                held[known[a][1]] -= 1
                if not held[known[a][1]]:
                    del held[known[a][1]]
                a += 1
            best = max(best, len(held))
        return best / len(want)

    def matches(self, texts: list[list[bytes]]):
        """(document, template, containment) of verified runs."""
        hasher = word_hasher()
        hashed = [shingle_hashes(word_hashes(w, hasher), SHINGLE) for w in texts]
        flat = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        for d, first, name in self.candidates(flat, [len(w) for w in texts]):
            width = (SPAN + 1) * self.lengths[name] + SHINGLE - 1
            share = self.share(name, texts[d][first:first + width])
            if share >= self.contained:
                yield d, name, share


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED) -> DataFrame:
    """doc_id, n_words, n_licences, licences (sorted, comma-joined), best (largest containment, 0 without a match)."""
    shared = docs.sparkSession.sparkContext.broadcast(templates or TEMPLATES)  # bounded by the templates
    src = docs.select("doc_id", "text")
    schema = StructType([src.schema["doc_id"]]).add("n_words", "long").add("n_licences", "long").add("licences", "string").add("best", "double")

    def run(batches):
        index = Templates(shared.value, contained)
        for batch in batches:
            found: list[dict] = [{} for _ in range(batch.num_rows)]
            sizes, held, rows, total = [], [], [], 0

            def flush():
                for d, name, share in index.matches(held):
                    own = found[rows[d]]
                    own[name] = max(share, own.get(name, 0.0))

            for r, text in enumerate(batch.column(1).to_pylist()):
                w = words_of(text)
                sizes.append(len(w))
                if held and total + len(w) > CHUNK_WORDS:
                    flush()
                    held, rows, total = [], [], 0
                held.append(w)
                rows.append(r)
                total += len(w)
            if held:
                flush()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes, pa.int64()), pa.array([len(f) for f in found], pa.int64()),
                pa.array([",".join(sorted(f)) for f in found], pa.string()),
                pa.array([max(f.values(), default=0.0) for f in found], pa.float64())], names=schema.names)

    return src.mapInArrow(run, schema)
