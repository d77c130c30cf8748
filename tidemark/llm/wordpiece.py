"""Greedy word-piece lengths by one linear pass (operator 9).

The vocabulary is a trie whose nodes carry a failure link and the number of pieces given up by following it, so a word is
counted in one step per character and no piece is built. A word ends with an end mark of its own, as in the vocabulary.

Null text has no words and no pieces. A word that the vocabulary cannot cover counts as one unknown piece.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from tidemark.llm.bpe import END, byte_letters, load
from tidemark.llm.common import WordCache, worker_cache


def token_symbols(token: str) -> list[str]:
    """Characters of a vocabulary entry, the end mark as one symbol."""
    return [*token[:-len(END)], END] if token.endswith(END) else list(token)


class Automaton:
    def __init__(self, vocab):
        self.step: list[dict] = [{}]
        final = [False]
        for token in vocab:
            u = 0
            for c in token_symbols(token):
                v = self.step[u].get(c)
                if v is None:
                    v = self.step[u][c] = len(self.step)
                    self.step.append({})
                    final.append(False)
                u = v
            final[u] = True
        self.fail: list[int | None] = [None] * len(self.step)
        self.popped = [0] * len(self.step)
        todo = deque([0])
        while todo:  # shallow nodes first
            p = todo.popleft()
            for c, v in self.step[p].items():
                if final[v]:
                    self.fail[v], self.popped[v] = 0, 1
                else:
                    z, n = self.fail[p], self.popped[p]
                    while z is not None and c not in self.step[z]:
                        n += self.popped[z]
                        z = self.fail[z]
                    if z is not None:
                        self.fail[v], self.popped[v] = self.step[z][c], n
                todo.append(v)

    def count(self, symbols: list[str]) -> int:
        """Pieces of the word; 1 if it cannot be covered."""
        u, n, step, fail, popped = 0, 0, self.step, self.fail, self.popped
        for c in symbols:
            while c not in step[u]:
                if fail[u] is None:
                    return 1
                n += popped[u]
                u = fail[u]
            u = step[u][c]
        while u:
            if fail[u] is None:
                return 1
            n += popped[u]
            u = fail[u]
        return n


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_pieces, longest: words by ASCII white space, A-Z lower-cased, of every whole text."""
    vocab = docs.sparkSession.sparkContext.broadcast(list(load(model_path)["vocab"]))  # bounded by the vocabulary
    src = docs.select("doc_id", "text")
    schema = StructType([src.schema["doc_id"]]).add("n_words", "long").add("n_pieces", "long").add("longest", "long")

    def make():
        automaton, letters = Automaton(vocab.value), byte_letters()
        return WordCache(lambda w: automaton.count([*map(letters.__getitem__, w), END]))

    def run(batches):
        counts = worker_cache(f"wordpiece-{len(vocab.value)}-{vocab.value[-1]}", make)
        for batch in batches:
            n, pieces, longest = [], [], []
            for text in batch.column(1).to_pylist():
                got = [counts[w] for w in (text or "").encode().lower().split()]  # bytes: only A-Z change
                n.append(len(got))
                pieces.append(sum(got))
                longest.append(max(got, default=0))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, pieces, longest))], names=schema.names)

    return src.mapInArrow(run, schema)
