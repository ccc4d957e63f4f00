"""Words, their hashes, and sets of word runs, computed on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """64-bit hashes of words; kept, and forgotten all at once when there are many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        return h


def word_hashes(text: str | None, known: WordHashes) -> np.ndarray:
    """Hashes of the words of a text in order, case ignored."""
    return np.array([known[w] for w in WORD.findall((text or "").lower())], dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    return h ^ (h >> np.uint64(27))


def run_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Distinct hashes of all runs of ``width`` words, sorted."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, width):
        h = mixed(h * _MUL + words[i : n + i])
    return np.unique(h)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def _jaccard_of(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            left, right, lt, rt = (c.to_pylist() for c in batch.columns)
            last, sets = None, []
            value = []
            for a, x, y in zip(left, lt, rt):
                if a != last:
                    last, sets = a, run_hashes(word_hashes(x, known), width)
                value.append(jaccard(sets, run_hashes(word_hashes(y, known), width)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(value, pa.float64())], names=["id_a", "id_b", "jaccard"])

    return run


def exact_jaccard(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """``id_a, id_b, jaccard`` over the word runs of the whole texts.

    ``pairs``: ``id_a, id_b`` long; ``texts``: ``id`` long (unique), ``text``. Only the
    texts named in a pair leave the scan's stage.
    """
    a = texts.select(F.col("id").alias("id_a"), F.col("text").alias("ta"))
    b = texts.select(F.col("id").alias("id_b"), F.col("text").alias("tb"))
    joined = pairs.select("id_a", "id_b").join(b, "id_b").join(a, "id_a").select("id_a", "id_b", "ta", "tb")
    return joined.mapInArrow(_jaccard_of(width), "id_a long, id_b long, jaccard double")
