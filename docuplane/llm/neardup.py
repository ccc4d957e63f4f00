"""Near-duplicate texts by a multi-index Hamming join of b-bit signatures.

A text's signature has ``chunks * symbols`` symbols, each the low 16 bits of one
minhash over its word runs; the distance of two signatures is the number of differing
symbols. Cut into ``chunks`` chunks, any pair within ``chunks * (errors + 1) - 1``
has, by the pigeonhole principle, a chunk with at most ``errors`` differing symbols.
So every chunk is entered once for each choice of ``errors`` symbols left out, and
texts that meet in an entry are candidates: no pair within that distance is lost,
and candidates are checked over their whole texts afterwards.

Texts with equal sets of runs are one class and enter the index once. An entry holds a
64-bit key, the class, and the symbol left out; a pair that agrees on a whole chunk is
taken from the chunk's first entry only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuplane.llm.shingles import WordHashes, exact_jaccard, mixed, run_hashes, word_hashes
from docuplane.session import stage_table


@dataclass(frozen=True)
class Signature:
    """The shape of a signature. With 16 chunks of 5 symbols and one error a pair is
    certain up to 31 of 80 differing symbols; a pair of similarity 0.6 that lies
    beyond is still met with a probability over 0.998 in all."""

    chunks: int = 16
    symbols: int = 5
    errors: int = 1
    width: int = 5
    min_words: int = 1
    seed: int = 11

    @property
    def size(self) -> int:
        return self.chunks * self.symbols

    @property
    def certain_distance(self) -> int:
        return self.chunks * (self.errors + 1) - 1

    def multipliers(self) -> tuple[np.ndarray, np.ndarray]:
        r = np.random.default_rng(self.seed)
        return r.integers(0, 2**63, self.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, self.size, dtype=np.uint64)


def signature_symbols(runs: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 16-bit symbol for each multiplier; the minimum is taken over the high bits.
    Very long texts are taken in slices, so that no large matrix is made."""
    lows = [(runs[None, i : i + 4096] * a[:, None] + b[:, None]).min(axis=1) for i in range(0, len(runs), 4096)]
    low = lows[0] if len(lows) == 1 else np.minimum.reduce(lows)
    return (mixed(low) & np.uint64(0xFFFF)).astype(np.uint16)


def _signatures(shape: Signature):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = shape.multipliers()
        known = WordHashes()
        for batch in batches:
            ids, prints, sigs = [], [], []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_hashes(text, known)
                if ident is None or len(words) < max(shape.min_words, 1):
                    continue
                runs = run_hashes(words, min(shape.width, len(words)))
                ids.append(ident)
                prints.append(int((mixed(runs).sum(dtype=np.uint64) ^ np.uint64(len(runs))).astype(np.int64)))
                sigs.append(signature_symbols(runs, a, b).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(prints, pa.int64()), pa.array(sigs, pa.binary())], names=["id", "print", "sig"])

    return run


def _entries(shape: Signature):
    kept = [c for c in combinations(range(shape.symbols), shape.symbols - shape.errors)]
    left = [[i for i in range(shape.symbols) if i not in c] for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            ids, sides = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, shape.chunks, shape.symbols).astype(np.uint64)
            keys, outs = [], []
            for k, c in enumerate(kept):
                h = np.full((n, shape.chunks), k * 1000, np.uint64) + np.arange(shape.chunks, dtype=np.uint64)
                for i in c:
                    h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, :, i] + np.uint64(1))
                out = np.zeros((n, shape.chunks), np.uint64)
                for i in left[k]:
                    out = out * np.uint64(65536) + sig[:, :, i]
                keys.append(h)
                outs.append(out.astype(np.int64) if k else np.full((n, shape.chunks), -1, np.int64))
            key = np.stack(keys, 1).reshape(-1).view(np.int64)
            out = np.stack(outs, 1).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(ids, shape.chunks * len(kept))), pa.array(out), pa.array(np.repeat(sides.astype(np.int32), shape.chunks * len(kept)))], names=["key", "rep", "out", "side"])

    return run


def _distance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint16).reshape(n, -1) for i in (2, 3))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((a != b).sum(axis=1).astype(np.int32))], names=["id_a", "id_b", "distance"])


@dataclass(frozen=True)
class NearDuplicates:
    """``members``: ``id, rep`` for every text long enough; ``links``: ``id_a, id_b,
    jaccard`` between representatives of different classes, ``id_a < id_b``."""

    members: DataFrame
    links: DataFrame


def signature_pairs(signed: DataFrame, shape: Signature, threshold: float, max_distance: int | None = None) -> DataFrame:
    """``id_a, id_b`` of signatures that meet in an entry and differ in at most
    ``max_distance`` symbols, ``id_a < id_b``.

    ``signed``: ``rep`` (unique), ``sig``, and a ``side`` of 1, 2 or 3 where only pairs
    across two sides are wanted (3: on both); then ``id_a`` is on the first. The bound
    on the distance only spares exact measurements: it is set five deviations beyond
    the mean of a pair at the threshold, unless given. Pairs within the certain
    distance all meet; of those between it and the bound, see ``Signature``.
    """
    across = "side" in signed.columns
    entries = signed.select("rep", "sig", F.col("side").cast("int") if across else F.lit(3).alias("side")).mapInArrow(_entries(shape), "key long, rep long, out long, side int")
    left = entries.select("key", F.col("rep").alias("id_a"), F.col("out").alias("oa"), F.col("side").alias("s_a"))
    right = entries.select("key", F.col("rep").alias("id_b"), F.col("out").alias("ob"), F.col("side").alias("s_b"))
    # sides are asked of both rows together, so that the one table of entries is shuffled once
    wanted = (F.col("s_a").bitwiseAND(F.lit(1)) + F.col("s_b").bitwiseAND(F.lit(2)) == 3) & (F.col("id_a") != F.col("id_b")) if across else F.col("id_a") < F.col("id_b")
    met = left.join(right, "key").where(wanted & ((F.col("oa") == -1) | (F.col("oa") != F.col("ob")))).select("id_a", "id_b").distinct()
    a, b = (signed.select(F.col("rep").alias(f"id_{x}"), F.col("sig").alias(f"s{x}")) for x in "ab")
    far = met.join(a, "id_a").join(b, "id_b")
    beyond = max_distance if max_distance is not None else int(shape.size * (1 - threshold) + 5 * (shape.size * threshold * (1 - threshold)) ** 0.5)
    return far.select("id_a", "id_b", "sa", "sb").mapInArrow(_distance, "id_a long, id_b long, distance int").where(F.col("distance") <= max(beyond, 0)).select("id_a", "id_b")


def near_duplicates(texts: DataFrame, *, id_col: str = "id", text_col: str = "text", threshold: float = 0.8, shape: Signature | None = None, max_distance: int | None = None) -> NearDuplicates:
    """Classes of equal texts and all links between them with a similarity of at least
    ``threshold``, the Jaccard coefficient of their runs of ``shape.width`` words.

    Equal means the same set of word runs, whatever the case and punctuation. A text
    shorter than a run is its own single run; a text of fewer than ``min_words`` words,
    null or empty, takes no part. Ids are unique; rows without one take no part. Very
    long texts are read whole. An empty table has no members and no links. Other
    columns are not read, whatever their names.
    """
    shape = shape or Signature()
    rows = texts.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    signed = stage_table(rows.mapInArrow(_signatures(shape), "id long, print long, sig binary"), "signatures")
    classes = signed.groupBy("print").agg(F.min(F.struct("id", "sig")).alias("r"))
    members = signed.select("id", "print").join(classes.select("print", F.col("r.id").alias("rep")), "print").select("id", "rep")
    reps = classes.select(F.col("r.id").alias("rep"), F.col("r.sig").alias("sig"))
    near = signature_pairs(reps, shape, threshold, max_distance)
    near = stage_table(near, "candidates")
    links = exact_jaccard(near, rows, shape.width).where(F.col("jaccard") >= threshold)
    return NearDuplicates(members, links)


def all_pairs(found: NearDuplicates) -> DataFrame:
    """Every pair of texts that are linked or equal, ``id_a < id_b``.

    For result forms that ask for pairs; it is as large as that form demands.
    """
    m = found.members
    a, b = m.select(F.col("id").alias("x"), F.col("rep").alias("id_a")), m.select(F.col("id").alias("y"), F.col("rep").alias("id_b"))
    across = found.links.select("id_a", "id_b").join(a, "id_a").join(b, "id_b").select("x", "y")
    within = a.join(b.withColumnRenamed("id_b", "id_a"), "id_a").where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def group_ids(links: DataFrame) -> DataFrame:
    """``rep, grp``: the smallest representative reachable over links, for linked ones.

    Each round a node takes the smallest label of its label and of its neighbours'
    labels, and hands what it found to the node that it is labelled with, so that roots
    hook onto each other and a chain's labels halve. Rounds go on until no label
    changes. Each is written to the shared folder; only whether there was a change
    reaches the driver.
    """
    both = links.select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))
    both = stage_table(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))), "edges")
    # l is a node's label, g that label's own label
    label = stage_table(both.select("u").distinct().select("u", F.col("u").alias("l"), F.col("u").alias("g")), "labels")
    while True:
        around = both.join(label.select(F.col("u").alias("v"), "g"), "v").groupBy("u").agg(F.min("g").alias("m"))
        lower = stage_table(label.join(around, "u"), "lower")
        hooked = lower.groupBy(F.col("l").alias("u")).agg(F.min("m").alias("h"))
        new = lower.join(hooked, "u", "left").select("u", F.col("l").alias("was"), F.least("g", "m", "h").alias("l"))
        new = stage_table(new, "labels")
        if new.where("l <> was").limit(1).count() == 0:
            return new.select(F.col("u").alias("rep"), F.col("l").alias("grp"))
        label = stage_table(new.select("u", "l").join(new.select(F.col("u").alias("l"), F.col("l").alias("g")), "l").select("u", "l", "g"), "labels")
