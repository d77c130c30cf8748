"""Removal of passages that a document with a smaller doc_id already holds (operator 6).

A window is 13 consecutive words. Each window stands under the smallest hash of its five-word runs (its minimizer), so equal
windows stand under equal minimizers and only one position in five has to be shuffled:

1. every distinct text emits (minimizer, document); minimizers of one document only are done with;
2. documents that share one send the passages of windows that stand under it, a few words longer than a window each;
3. passages meet by minimizer, in the order of their documents. The passages of smaller documents form a reference shard
   with a suffix automaton; a later passage is streamed through it for matching statistics, and every position where
   a match reaches 13 words closes a window that is removed. Words are compared as such, never their hashes.

A minimizer at the end of a passage that many documents share stands for as many different windows as there are documents,
with each one's own neighbouring words. Passages of a minimizer met more than `HEAVY` times are therefore cut into their
windows, which meet by minimizer and a hash of the window: copies of one window meet, different ones go to different shards.

Exact copies of a text are settled before: only the smallest document of each text takes part.

Null text has no words. A null doc_id counts as larger than any. Rows that share a doc_id do not remove from each other.
Repeated rows give repeated results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.llm.common import shingle_hashes, sliding_min, word_hasher, word_hashes

WINDOW, GRAM, LAST_ID = 13, 5, (1 << 63) - 1
BATCH_ROWS, HEAVY = 20_000, 1_000


class SuffixAutomaton:
    """Online automaton of several word sequences; a state per set of end positions."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def _extend(self, last: int, word) -> int:
        nxt, link, length = self.next, self.link, self.length
        q = nxt[last].get(word)
        if q is not None and length[q] == length[last] + 1:
            return q
        if q is not None:
            return self._split(last, word, q)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and word not in nxt[p]:
            nxt[p][word] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][word]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, word, q)
        return cur

    def _split(self, p: int, word, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(word) == q:
            nxt[p][word] = clone
            p = link[p]
        return clone

    def add(self, words: list) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def matches(self, words: list) -> list[int]:
        """Length of the longest known match that ends at each word."""
        nxt, link, length = self.next, self.link, self.length
        u, n, out = 0, 0, []
        for w in words:
            while u and w not in nxt[u]:
                u = link[u]
                n = length[u]
            if w in nxt[u]:
                u = nxt[u][w]
                n += 1
            out.append(n)
        return out


def window_keys(words: list[bytes], hasher, window: int) -> np.ndarray:
    """Minimizer of each window of the text."""
    if len(words) < window:
        return np.zeros(0, np.uint64)
    gram = min(GRAM, window)
    return sliding_min(shingle_hashes(word_hashes(words, hasher), gram), window - gram + 1)


def _words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


class Shard:
    """Passages under one minimizer, or windows of it under one hash, in the order of their documents."""

    def __init__(self, window: int):
        self.window, self.first, self.waiting = window, {}, []  # text -> its smallest document
        self.automaton, self.doc, self.least = None, None, None

    def covered(self, doc: int, passage: bytes) -> list[tuple[int, int]]:
        """Word ranges of the passage that smaller documents hold."""
        if doc != self.doc:
            self.least = doc if self.least is None else self.least
            self.doc, ready = doc, self.waiting
            self.waiting = []
            for p in ready:
                if self.automaton is not None:
                    self.automaton.add(p.split(b" "))
        known = self.first.get(passage)
        if known is not None and known < doc:
            return [(0, passage.count(b" ") + 1)]
        out = []
        if self.least < doc:
            if self.automaton is None:
                self.automaton = SuffixAutomaton()
                for p, d in self.first.items():
                    if d < doc:
                        self.automaton.add(p.split(b" "))
            for end, n in enumerate(self.automaton.matches(passage.split(b" ")), 1):
                if n >= self.window:
                    a = end - self.window
                    if out and out[-1][1] >= a:
                        out[-1] = (out[-1][0], end)
                    else:
                        out.append((a, end))
        if known is None:
            self.first[passage] = doc
            self.waiting.append(passage)
        return out


def _packed(docs: DataFrame) -> DataFrame:
    """d, text, sha, rest: the id as a number, the text, its digest, all columns of the row except the text."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("d"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("sha"),
                       F.col("text").isNull().alias("void"), F.struct(*rest).alias("rest"))


def _firsts(rows: DataFrame) -> DataFrame:
    """key (a document), shas: digests of the texts that it holds first."""
    return rows.groupBy("sha").agg(F.min("d").alias("d")).groupBy(F.col("d").alias("key")).agg(F.collect_list("sha").alias("shas"))


def passages_to_meet(rows: DataFrame, firsts: DataFrame, window: int) -> DataFrame:
    """h, part, d, t, at, words: passages of minimizers that several documents share; equal (h, part) have to meet."""
    mine = rows.join(firsts.hint("shuffle_hash"), F.col("d") == F.col("key"))

    def emit(batches):
        hasher = word_hasher()
        for b in batches:
            hs, ds = [], []
            for text, d, sha, shas in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("text", "d", "sha", "shas"))):
                if sha in shas:
                    v = window_keys(_words(text), hasher, window)
                    if len(v):
                        v = v[np.append(True, v[1:] != v[:-1])]
                        hs.append(v)
                        ds.append(np.full(len(v), d, np.int64))
            if hs:
                h, d = np.concatenate(hs).view(np.int64), np.concatenate(ds)
                for i in range(0, len(h), BATCH_ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(h[i:i + BATCH_ROWS]), pa.array(d[i:i + BATCH_ROWS])], names=["h", "d"])

    emitted = mine.mapInArrow(emit, "h long, d long")
    shared = emitted.groupBy("h").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.count("d").alias("n")).where("least < most").select("h", (F.col("n") > HEAVY).alias("heavy"))
    wanted = (emitted.join(shared.hint("shuffle_hash"), "h").groupBy(F.col("d").alias("key")).agg(F.collect_list("h").alias("hs"), F.collect_list(F.when(F.col("heavy"), F.col("h"))).alias("heavy")))
    sharing = rows.join(wanted.hint("shuffle_hash"), F.col("d") == F.col("key"))

    def passages(batches):
        hasher = word_hasher()
        for b in batches:
            out: list[tuple] = []
            for text, d, hs, heavy in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("text", "d", "hs", "heavy"))):
                words = _words(text)
                v = window_keys(words, hasher, window).view(np.int64)
                if not len(v):
                    continue
                t = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                starts = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
                ends = np.append(starts[1:], len(v)) + window - 1
                heavy, places = set(heavy), {}  # a document sends a window once, with all its places
                use = np.isin(v[starts], np.array(hs, np.int64))
                for h, i, j in zip(v[starts[use]].tolist(), starts[use].tolist(), ends[use].tolist()):
                    if h not in heavy:
                        out.append((h, 0, d, t, [i], b" ".join(words[i:j])))
                        continue
                    for k in range(i, j - window + 1):
                        places.setdefault((h, b" ".join(words[k:k + window])), []).append(k)
                out += [(h, xxhash.xxh64_intdigest(w) - (1 << 63), d, t, at, w) for (h, w), at in places.items()]
                if len(out) >= BATCH_ROWS:
                    yield _batch(out, PASSAGE)
                    out = []
            if out:
                yield _batch(out, PASSAGE)

    return sharing.mapInArrow(passages, "h long, part long, d long, t long, at array<int>, words binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """rest (struct of the row's other columns), text (kept words joined by a space; null stays null), n_words, n_removed."""
    rows = _packed(docs)
    firsts = _firsts(rows)
    met = passages_to_meet(rows, firsts, window).repartition("h", "part").sortWithinPartitions("h", "part", "d")

    def judge(batches):
        key, shard, out = None, None, []
        for b in batches:
            for h, part, d, t, at, words in zip(*(c.to_pylist() for c in b.columns)):
                if (h, part) != key:
                    key, shard = (h, part), Shard(window)
                end = -1
                for x, y in ((a + x, a + y) for spans in [shard.covered(d, words)] for a in at for x, y in spans):
                    if x <= end:
                        out[-1] = (d, t, out[-1][2], y)
                    else:
                        out.append((d, t, x, y))
                    end = y
                if len(out) >= BATCH_ROWS:
                    yield _batch(out, COVERED)
                    out = []
        if out:
            yield _batch(out, COVERED)

    spans = met.mapInArrow(judge, "d long, t long, from int, to int")
    spans = spans.groupBy(F.col("d").alias("key")).agg(F.collect_list(F.struct("t", "from", "to")).alias("spans"))
    told = firsts.join(spans, "key", "left")
    final = rows.join(told.hint("shuffle_hash"), F.col("d") == F.col("key"), "left").select("d", "text", "sha", "void", "rest", "shas", "spans")
    schema = StructType([final.schema["rest"]]).add("text", "string").add("n_words", "long").add("n_removed", "long")

    def cut(batches):
        for b in batches:
            at = {c: b.schema.get_field_index(c) for c in b.schema.names}
            texts, n_words, n_removed = [], [], []
            for text, sha, shas, void, spans in zip(*(b.column(at[c]).to_pylist() for c in ("text", "sha", "shas", "void", "spans"))):
                words = _words(text)
                n = len(words)
                if n >= window and sha not in (shas or ()):
                    words = []  # an exact copy of a smaller document
                elif spans:
                    t = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)
                    gone = np.zeros(n + 1, np.int64)
                    for s in spans:
                        if s["t"] == t:
                            gone[s["from"]] += 1
                            gone[s["to"]] -= 1
                    gone = np.cumsum(gone[:-1])
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                texts.append(None if void else b" ".join(words).decode("utf-8", "surrogatepass"))
                n_words.append(n)
                n_removed.append(n - len(words))
            yield pa.RecordBatch.from_arrays([b.column(at["rest"]), pa.array(texts, pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=schema.names)

    return final.mapInArrow(cut, schema)


PASSAGE = pa.schema([("h", pa.int64()), ("part", pa.int64()), ("d", pa.int64()), ("t", pa.int64()), ("at", pa.list_(pa.int32())), ("words", pa.binary())])
COVERED = pa.schema([("d", pa.int64()), ("t", pa.int64()), ("from", pa.int32()), ("to", pa.int32())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
