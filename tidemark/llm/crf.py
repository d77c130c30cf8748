"""Language of code-switched text with a linear-chain conditional random field (operator 1).

Every word is labelled: affixes, character trigrams and per-language lexicons give label scores, learned transitions tie
neighbours, forward-backward gives each word's label probabilities. A document takes the label with the highest mean
probability; the words' own labels and shares come from the same table.

The field is fitted on the driver on a bounded sample (`SAMPLE_DOCS` different labelled texts per language, of each at most
`SAMPLE_CHARS` characters in a row), cut and shuffled into code-switched sequences. Prediction reads every whole text and only the text.

Null text and text without a letter: `und`, score 0. No labelled row at all: everything is `und`.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import forget

SAMPLE_DOCS, SAMPLE_CHARS = 150, 20_000
SPACE_BITS, LEXICON, SEQUENCE, SEQUENCES, BATCH, EPOCHS, RATE = 16, 300, 120, 1_600, 32, 2, 0.3
BATCH_WORDS = 400_000  # words whose probabilities are held at once; a longer document is held alone
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


@dataclass
class Model:
    labels: list[str]
    lexicon: dict[str, tuple[int, ...]]  # word -> labels whose lexicon has it
    weights: np.ndarray  # feature x label
    moves: np.ndarray  # label x label


def features(word: str, lexicon: dict[str, tuple[int, ...]]) -> list[int]:
    """Hashed affix, trigram and lexicon features of a lower-cased word."""
    w = f"^{word}$"
    found = [w[:2], w[:3], w[:4], w[-2:], w[-3:], w[-4:]]
    own = [zlib.crc32(f"{i}{x}".encode()) for i, x in enumerate(found)]
    own += [zlib.crc32(w[i:i + 3].encode()) for i in range(len(w) - 2)]
    own += [zlib.crc32(b"lexicon%d" % k) for k in lexicon.get(word, ())]
    return [x & ((1 << SPACE_BITS) - 1) for x in own]


def scores(words: list[str], model: Model) -> np.ndarray:
    """Label scores of distinct words, word x label."""
    out = np.zeros((len(words), len(model.labels)), np.float32)
    for a in range(0, len(words), 20_000):
        flat, starts = [], []
        for w in words[a:a + 20_000]:
            starts.append(len(flat))
            flat.extend(features(w, model.lexicon))
        out[a:a + len(starts)] = np.add.reduceat(model.weights[np.array(flat)], np.array(starts), axis=0)
    return out


def marginals(scored: np.ndarray, lengths: np.ndarray, moves: np.ndarray, ahead: np.ndarray | None = None, behind: np.ndarray | None = None) -> np.ndarray:
    """Forward-backward over sequences laid end to end; all sequences advance together, longest first. `ahead` and `behind`
    take the scaled forward and backward messages."""
    e = np.exp(scored - scored.max(axis=1, keepdims=True)).astype(np.float32)
    a = np.exp(moves - moves.max()).astype(np.float32)
    order = np.argsort(-lengths, kind="stable")
    at = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    alive = np.searchsorted(-sizes, -np.arange(int(sizes[0]) if len(sizes) else 0), side="left")  # sequences longer than t
    tiny = np.float32(1e-30)
    out = np.empty_like(e)
    state = None
    for t, k in enumerate(alive):
        i = at[:k] + t
        state = e[i] if state is None else (state[:k] @ a) * e[i] + tiny
        state /= state.sum(axis=1, keepdims=True)
        out[i] = state
    if ahead is not None:
        ahead[:] = out
    later = np.zeros((0, e.shape[1]), np.float32)
    for t in range(len(alive) - 1, -1, -1):
        i = at[:alive[t]] + t
        if len(i) > len(later):
            later = np.concatenate([later, np.ones((len(i) - len(later), e.shape[1]), np.float32)])
        out[i] *= later
        if behind is not None:
            behind[i] = later
        later = (e[i] * later) @ a.T + tiny
        later /= later.sum(axis=1, keepdims=True)
    out += tiny
    out /= out.sum(axis=1, keepdims=True)
    return out


def pair_marginals(scored: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """marginals(), the words that have a next one in their sequence, and their label pairs' probabilities, word x label x label."""
    ahead, behind = np.empty(scored.shape, np.float32), np.empty(scored.shape, np.float32)
    p = marginals(scored, lengths, moves, ahead, behind)
    last = np.zeros(len(scored), bool)
    last[np.cumsum(lengths) - 1] = True
    i = np.flatnonzero(~last)
    entered = np.exp(scored[i + 1] - scored[i + 1].max(axis=1, keepdims=True)) * behind[i + 1]
    pair = ahead[i][:, :, None] * np.exp(moves - moves.max())[None] * entered[:, None, :] + np.float32(1e-30)
    return p, i, pair / pair.sum(axis=(1, 2), keepdims=True)


def train(rows: list[tuple[str, str]], seed: int = 5) -> Model:
    """Fits on (text, label) rows; sequences mix pieces of random documents of random labels."""
    labels = sorted({lab for _, lab in rows})
    own = {lab: k for k, lab in enumerate(labels)}
    docs = sorted((lab, WORD.findall(t.lower())) for t, lab in rows)
    docs = [(own[lab], ws) for lab, ws in docs if ws]
    counts = [Counter() for _ in labels]
    for k, ws in docs:
        counts[k].update(ws)
    lexicon: dict[str, tuple[int, ...]] = {}
    for k, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[w] = (*lexicon.get(w, ()), k)
    n = len(labels)
    model = Model(labels, lexicon, np.zeros((1 << SPACE_BITS, n), np.float32), np.zeros((n, n), np.float32))
    if n < 2:
        return model
    rng = np.random.default_rng(seed)
    by = [[ws for j, ws in docs if j == k] for k in range(n)]
    have = [k for k in range(n) if by[k]]
    seqs, gold = [], []
    for _ in range(SEQUENCES):
        ws, ys = [], []
        while len(ws) < SEQUENCE:
            k = have[rng.integers(len(have))]
            doc = by[k][rng.integers(len(by[k]))]
            size = int(rng.integers(4, 60))
            a = int(rng.integers(max(1, len(doc) - size)))
            ws += doc[a:a + size]
            ys += [k] * len(doc[a:a + size])
        seqs.append(ws[:SEQUENCE])
        gold.append(ys[:SEQUENCE])
    known = {w: features(w, lexicon) for w in {w for s in seqs for w in s}}
    g_w, g_m = np.full(model.weights.shape, 1e-2, np.float32), np.full((n, n), 1e-2, np.float32)
    for _ in range(EPOCHS):
        for b in range(0, SEQUENCES, BATCH):
            words = [w for s in seqs[b:b + BATCH] for w in s]
            y = np.array([k for s in gold[b:b + BATCH] for k in s])
            feats = [known[w] for w in words]
            flat = np.array([f for fs in feats for f in fs])
            rows_of = np.repeat(np.arange(len(words)), [len(f) for f in feats])
            starts = np.cumsum([0] + [len(f) for f in feats[:-1]])
            e = np.add.reduceat(model.weights[flat], starts, axis=0)
            p, i, pair = pair_marginals(e, np.full(len(words) // SEQUENCE, SEQUENCE), model.moves)
            diff = -p
            diff[np.arange(len(words)), y] += 1
            grad = np.stack([np.bincount(flat, diff[rows_of, k], 1 << SPACE_BITS) for k in range(n)], axis=1) / BATCH
            want = np.zeros((n, n), np.float32)
            np.add.at(want, (y[i], y[i + 1]), 1)
            move = (want - pair.sum(axis=0)) / BATCH
            g_w += grad ** 2
            g_m += move ** 2
            model.weights += RATE * grad / np.sqrt(g_w)
            model.moves += RATE * move / np.sqrt(g_m)
    return model


def sample(docs: DataFrame, fits: Column) -> list[tuple[str, str]]:
    """At most SAMPLE_DOCS different labelled texts per language, spread by a hash of the text; ids first, then only their
    texts. Of a longer text a piece of SAMPLE_CHARS at a place given by the hash."""
    ok = docs.where(fits & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.char_length("text") > 0)).select("lang", F.xxhash64("text").alias("h"), "text")
    first = Window.partitionBy("lang").orderBy("h")
    picked = ok.select("lang", "h").distinct().withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE_DOCS)
    keys = {(r["lang"], r["h"]) for r in picked.select("lang", "h").collect()}  # bounded: SAMPLE_DOCS per language
    over = F.char_length("text") - SAMPLE_CHARS
    piece = F.when(over <= 0, F.col("text")).otherwise(F.substring("text", F.pmod("h", over + 1).cast("int") + 1, F.lit(SAMPLE_CHARS)))
    got = ok.where(F.col("h").isin(sorted({h for _, h in keys}))).select("lang", "h", piece.alias("text")).dropDuplicates(["lang", "h"]).collect() if keys else []
    return sorted((r["text"], r["lang"]) for r in got if (r["lang"], r["h"]) in keys)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; null counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def fit(docs: DataFrame) -> Model:
    """Learns from the text and lang of the documents outside the held-out fold."""
    src = docs.select("doc_id", "text", "lang")
    return train(sample(src, fold(F.col("doc_id")) != 0))


def label_words(texts: list[str | None], model: Model):
    """(document, its words, word x label probabilities) of the texts that have a letter."""
    held, size = [], 0

    def flush():
        index: dict[str, int] = {}
        ids = [index.setdefault(w, len(index)) for _, ws in held for w in ws]
        lengths = np.array([len(ws) for _, ws in held])
        p = marginals(scores(list(index), model)[np.array(ids)], lengths, model.moves)
        ends = np.cumsum(lengths)
        for (d, ws), a, b in zip(held, ends - lengths, ends):
            yield d, ws, p[a:b]

    # longest first: sequences that advance together are of like length
    for d, text in sorted(enumerate(texts), key=lambda x: -len(x[1] or "")):
        if not text or not model.labels or not any(map(str.isalpha, text)):
            continue
        ws = WORD.findall(text.lower())
        if held and size + len(ws) > BATCH_WORDS:
            yield from flush()
            held, size = [], 0
        held.append((d, ws))
        size += len(ws)
    if held:
        yield from flush()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The columns of `docs` with lang_pred, score and switches (changes of label between neighbouring words) set."""
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.lexicon, model.weights, model.moves))  # bounded: features x labels
    src = docs.drop("lang_pred", "score", "switches")
    schema = StructType(list(src.schema)).add("lang_pred", "string").add("score", "double").add("switches", "long")

    def run(batches):
        forget()
        m = Model(*shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            lang, score, switches = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
            for d, _, p in label_words(texts, m):
                mean = p.mean(axis=0, dtype=np.float64)
                k = int(mean.argmax())
                best = p.argmax(axis=1)
                lang[d], score[d], switches[d] = m.labels[k], min(1.0, float(mean[k])), int(np.count_nonzero(best[1:] != best[:-1]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(switches, pa.int64())], names=schema.names)

    return src.mapInArrow(run, schema)
