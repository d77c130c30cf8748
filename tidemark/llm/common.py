"""Helpers that several text operators share."""

from __future__ import annotations

import gc
import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CACHE_WORDS = 120_000  # entries of a worker's word cache; results do not depend on it
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, all other characters kept; texts of single bytes take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _store() -> dict:
    return sys.modules.setdefault("_tidemark_worker_store", types.ModuleType("_tidemark_worker_store")).__dict__.setdefault("held", {})


def forget() -> None:
    """Frees what earlier operators hold in this Python worker; Spark reuses workers from stage to stage."""
    if _store():
        _store().clear()
        gc.collect()
        pa.default_memory_pool().release_unused()


def worker_cache(key: str, make: Callable):
    """What `make` returns, made once in a Python worker and held until another operator's cache takes its place."""
    if key not in _store():
        forget()
        _store()[key] = make()
    return _store()[key]


class WordCache(dict):
    """word -> value of `f(word)` in two generations: a full one ages and replaces the aged one, so words in use stay and no
    more than `size` are held."""

    def __init__(self, f: Callable, size: int = CACHE_WORDS):
        super().__init__()
        self.f, self.half, self.aged = f, size // 2, {}

    def __missing__(self, word):
        if len(self) >= self.half:
            self.aged = dict(self)
            self.clear()
        v = self.aged.get(word)
        if v is None:
            v = self.f(word)
        self[word] = v
        return v


def word_hasher() -> WordCache:
    """bytes of a word -> 64-bit hash, shared by the tasks of a worker."""
    import xxhash
    return worker_cache("word_hash", lambda: WordCache(xxhash.xxh64_intdigest))


def word_hashes(words: list[bytes], hasher: WordCache) -> np.ndarray:
    return np.fromiter(map(hasher.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scramble of 64-bit values, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_ODD = np.random.default_rng(20240607).integers(1, 2 ** 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k words; of the whole sequence if it is shorter; none for no words."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h += words[i:n - k + 1 + i] * _ODD[i]
    return mix(h)


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, by doubling."""
    size, out = 1, v
    while size < w:
        step = min(size, w - size)
        out = np.minimum(out[:-step], out[step:])
        size += step
    return out
