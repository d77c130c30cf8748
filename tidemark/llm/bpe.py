"""BPE encoding and decoding by tree concatenation (operator 10).

Text is cut at special tokens and white space; every word is normalised and cut into pre-tokens. A pre-token is not merged
as a whole: it is halved down to leaves of at most `LEAF` letters, leaves are encoded on their own, and two neighbours are
joined by encoding a growing window of tokens around the seam anew until its first and last tokens equal those of both
sides. An adjacent pair of tokens that encodes to itself is all that decides an encoding, so the joined result is exact.
Leaves and windows are few and short, so most are looked up. Texts are encoded in parallel by Spark; the halves of one
pre-token are encoded by the task that holds its text. The decoded text is decoded from the ids.

Null text counts as empty: no tokens, empty decoded text. Repeated rows give repeated results.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructType

from tidemark.llm.common import CACHE_WORDS, WordCache, worker_cache

LEAF = 8  # letters of a leaf of the tree at most
WORDS_HELD = 5 * CACHE_WORDS  # measure of the words, leaves and seams that a worker holds; results do not depend on it
BITS, MASK, NEVER = 20, (1 << 20) - 1, 1 << 60  # of a token's number; rank of a pair that does not merge
#: Pre-token pattern and white space of the vocabulary's own tokenizer.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^" + SPACE + r"\p{L}\p{N}]+"
END = "</w>"


def byte_letters() -> list[str]:
    """Printable stand-in of each byte: visible Latin-1 characters stand for themselves, the rest follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


def load(path: str) -> dict:
    """Vocabulary, merges and special tokens of a tokenizer file; read where the query is planned."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    return {"vocab": spec["model"]["vocab"], "merges": merges, "special": {t["content"]: t["id"] for t in spec["added_tokens"]}}


class Bpe:
    """Tokens are held as numbers of `names`: letters and what merges make of them, in vocabulary or not."""

    def __init__(self, model: dict, leaf: int = LEAF, held: int = WORDS_HELD):
        self.vocab, self.special, self.leaf = model["vocab"], model["special"], leaf
        self.mapped = dict(enumerate(byte_letters()))
        self.names = list(dict.fromkeys([*(x + end for x in self.mapped.values() for end in ("", END)), *(y for a, b in model["merges"] for y in (a, b, a + b))]))
        number = {t: i for i, t in enumerate(self.names)}
        self.inner, self.final = ({x: number[x + end] for x in self.mapped.values()} for end in ("", END))
        self.merged = {number[a] << BITS | number[b]: rank << BITS | number[a + b] for rank, (a, b) in enumerate(model["merges"])}
        self.ids = [self.vocab.get(t, -1) for t in self.names]
        self.spelt = [tuple(number[x] for x in self.symbols(t)) for t in self.names]
        self.pre = regex.compile(PRETOKEN)
        self.space = regex.compile(f"[{SPACE}]+")
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.tokens = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.numbers = {i: str(i) for i in self.tokens}
        self.joins = 0  # joins of the tree so far
        self.leaves = WordCache(self._leaf, held // 4)
        self.seams = WordCache(self._seam, held // 4)
        self.units = WordCache(self.unit, held // 4)
        self.words = WordCache(self._word, 2 * held)

    @staticmethod
    def symbols(token: str) -> list[str]:
        if token.endswith(END) and token != END:
            s = list(token[:-len(END)])
            s[-1] += END
            return s
        return list(token)

    # -- merging -------------------------------------------------------------------------------------------------
    def merge(self, s: list[int]) -> list[int]:
        """All merges of a symbol sequence, lowest rank first, leftmost among equals."""
        if len(s) > 64:
            return self._merge_long(s)
        get = self.merged.get
        ranks = [get(a << BITS | b, NEVER) for a, b in zip(s, s[1:])]  # only the two pairs beside a merge change
        while ranks and (best := min(ranks)) != NEVER:
            at = ranks.index(best)
            s[at] = new = best & MASK
            del s[at + 1], ranks[at]
            if at < len(ranks):
                ranks[at] = get(new << BITS | s[at + 1], NEVER)
            if at:
                ranks[at - 1] = get(s[at - 1] << BITS | new, NEVER)
        return s

    def _merge_long(self, s: list[int]) -> list[int]:
        """The same merges with a heap of pairs and linked neighbours."""
        n, get = len(s), self.merged.get
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(m, i, s[i], s[i + 1]) for i in range(n - 1) if (m := get(s[i] << BITS | s[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = right[i]
            if s[i] != a or j >= n or s[j] != b:
                continue
            s[i], s[j] = m & MASK, -1
            right[i] = right[j]
            if right[i] < n:
                left[right[i]] = i
            for x, y in ((left[i], i), (i, right[i])):
                if x >= 0 and y < n and (m := get(s[x] << BITS | s[y])) is not None:
                    heapq.heappush(heap, (m, x, s[x], s[y]))
        return [x for x in s if x >= 0]

    def _leaf(self, letters: str) -> tuple[int, ...]:
        """Merged tokens of a leaf; a closing space, which is no letter, marks the end of the pre-token."""
        if letters[-1] == " ":
            return tuple(self.merge([*map(self.inner.__getitem__, letters[:-2]), self.final[letters[-2]]]))
        return tuple(self.merge(list(map(self.inner.__getitem__, letters))))

    def _seam(self, pair: int) -> tuple[int, ...] | None:
        """The tokens that two neighbouring tokens are encoded to, None if to themselves."""
        a, b = pair >> BITS, pair & MASK
        win = self.merge([*self.spelt[a], *self.spelt[b]])
        return None if len(win) == 2 and win[0] == a else tuple(win)

    def encode_tree(self, letters: str) -> tuple[int, ...]:
        """Tokens of a pre-token's letters: halves down to leaves, joined level by level."""
        n = len(letters)
        if n <= self.leaf:
            return self.leaves[letters + " "]
        pieces = 1 << ((n - 1) // self.leaf).bit_length()
        cut = [n * i // pieces for i in range(pieces)]
        level = [self.leaves[letters[a:b]] for a, b in zip(cut, cut[1:])]
        level.append(self.leaves[letters[cut[-1]:] + " "])
        while len(level) > 1:
            level = [self.join(a, b) for a, b in zip(level[::2], level[1::2])]
        return level[0]

    def join(self, a: tuple[int, ...], b: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of two encoded neighbours: a window around the seam grows until its ends agree with both sides."""
        self.joins += 1
        win = self.seams[a[-1] << BITS | b[0]]
        if win is None:
            return a + b
        if (len(a) == 1 or win[0] == a[-1]) and (len(b) == 1 or win[-1] == b[0]):
            return a[:-1] + win + b[1:]
        k = 2
        while True:
            x, y = a[-k:], b[:k]
            win = self.merge([c for t in x + y for c in self.spelt[t]])
            if (k >= len(a) or win[0] == x[0]) and (k >= len(b) or win[-1] == y[-1]):
                return a[:-k] + tuple(win) + b[k:]
            k *= 2

    # -- words and texts -----------------------------------------------------------------------------------------
    def unit(self, pretoken: str) -> tuple[int, ...]:
        """Ids of one pre-token."""
        plain = pretoken.isascii() and pretoken.isprintable()  # each letter stands for itself
        letters = pretoken if plain else pretoken.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.mapped)
        ids = tuple(map(self.ids.__getitem__, self.encode_tree(letters)))
        return ids if -1 not in ids else tuple(i for i in ids if i >= 0)

    def _word(self, word: str) -> tuple[int, ...]:
        """Ids of a word; its lower case and its parts are looked up as words of their own."""
        w = word if word.isascii() else unicodedata.normalize("NFC", word)
        w = w.lower() if "Σ" not in w else "".join(map(str.lower, w))  # the tokenizer knows no final sigma
        latin = w.isascii() or max(w) < "\u0250"  # letters on whose class all tables agree
        if latin and w.isalpha():
            return self.unit(w) if w == word else self.words[w]
        if latin and w[-1] in ".,;:!?" and w[:-1].isalpha():
            return self.words[w[:-1]] + self.words[w[-1]]
        return tuple([i for p in self.pre.findall(w) for i in self.units[p]])

    def ids_of(self, text: str) -> list[int]:
        """Token ids of a whole text."""
        out: list[int] = []
        for part in (self.cut.split(text) if self.cut and any(t in text for t in self.special) else (text,)):
            if part in self.special:
                out.append(self.special[part])
            elif part:
                # str.split also cuts at four separators that are no white space to the tokenizer
                split = part.split() if not any(c in part for c in "\x1c\x1d\x1e\x1f") else [w for w in self.space.split(part) if w]
                out.extend(chain.from_iterable(map(self.words.__getitem__, split)))
        return out

    def decode(self, ids) -> str:
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


def _worker(model, leaf: int, held: int = WORDS_HELD) -> Bpe:
    return worker_cache(f"bpe-{hash(tuple(model.value['merges'][:9]))}-{len(model.value['vocab'])}-{leaf}-{held}", lambda: Bpe(model.value, leaf, held))


def _column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def encode(docs: DataFrame, model_path: str, leaf: int = LEAF, with_ids: bool = True, held: int = WORDS_HELD) -> DataFrame:
    """doc_id, n_tokens, ids (if asked for), decoded: token ids of every whole text and the text decoded from them."""
    model = docs.sparkSession.sparkContext.broadcast(load(model_path))  # bounded by the vocabulary
    src = docs.select(F.col("doc_id"), F.col("text"))
    schema = StructType([src.schema["doc_id"]]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))

    def run(batches):
        bpe = _worker(model, leaf, held)
        for batch in batches:
            n, ids_sha, dec_sha, flat, ends = [], [], [], array("i"), [0]
            for text in _column(batch, "text"):
                ids = bpe.ids_of(text or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(bpe.numbers.__getitem__, ids)).encode()).hexdigest())
                dec_sha.append(hashlib.sha256(bpe.decode(ids).encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    flat.extend(ids)
                    ends.append(len(flat))
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(dec_sha, pa.string())]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return src.mapInArrow(run, schema)


def decode(tokens: DataFrame, model_path: str) -> DataFrame:
    """doc_id, decoded: the text of each row's `ids`, null ids as empty text."""
    model = tokens.sparkSession.sparkContext.broadcast(load(model_path))
    src = tokens.select("doc_id", "ids")
    schema = StructType([src.schema["doc_id"]]).add("decoded", "string")

    def run(batches):
        bpe = _worker(model, LEAF)
        for batch in batches:
            out = [bpe.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=schema.names)

    return src.mapInArrow(run, schema)
