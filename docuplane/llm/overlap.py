"""Records of one split found again in another, by content-defined chunks.

A normalised record is its sequence of word hashes. A rolling hash over the last two
words cuts it where the hash falls on a mask, so that an edit moves the nearest cuts
only. Digests of the chunks are joined across splits; the lengths of shared chunks
make a record's overlap fraction.

Frequent chunks (boilerplate) would pair everything with everything. The index
therefore takes a record's chunks from the rarest on, and leaves out the most frequent
ones as long as their total length stays below ``LEFT_OUT`` of what ``min_overlap``
asks of the record. What two records share in words beyond the left-out ones of either
is then in the index of both: a pair that reaches the fraction shares there at least
the words asked for less those left out. The lengths of a pair's common index chunks
are summed and held against that, and only pairs that pass are measured over all their
chunks; no pair that reaches the fraction is lost. In a large collection most pairs
that meet have one chunk in common by chance, and go no further than this sum. All this
holds for any order that all records share; the better it knows what is frequent, the
fewer pairs meet. The order comes from counts of all records' chunks in ``SLOTS``
slots, a sketch whose size does not depend on the data and which needs no shuffle of
digests.

Scattered edits can break most chunks of a short pair whose word runs are still mostly
the same. With a ``signature`` the operator therefore takes, besides, the pairs that a
Hamming join of signatures over the runs proposes; their fractions are measured over
the chunks like any other's. A pair is then missed only if both indexes miss it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuplane.llm.neardup import Signature, signature_pairs, signature_symbols
from docuplane.llm.shingles import WordHashes, mixed, run_hashes, word_hashes
from docuplane.session import shuffles_dropped, stage_table

_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 2**64)
#: Slots of the count sketch, whatever the data: 4 MB once merged.
SLOTS = 1 << 22
_BLOCK = 1 << 16
#: Nearer to 1, fewer pairs meet and more of them must be measured.
LEFT_OUT = 0.8


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def chunk_record(words: np.ndarray, mask: int = 3, shortest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Digests and lengths in words of the chunks of a record."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rolling = mixed(words.copy())
    rolling[1:] = mixed(words[1:] + words[:-1] * np.uint64(_BASE))
    cuts, last = [0], 0
    for c in (np.flatnonzero((rolling >> np.uint64(20)) & np.uint64(mask) == 0) + 1).tolist():
        if c - last >= shortest:
            cuts.append(c)
            last = c
    if cuts[-1] != n:
        cuts.append(n)
    at = np.array(cuts)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(_BASE, n), dtype=np.uint64)])
    digest = mixed((sums[at[1:]] - sums[at[:-1]]) * _powers(_INVERSE, n + 1)[at[:-1]] + (at[1:] - at[:-1]).astype(np.uint64))
    return digest, np.diff(at)


def _slots(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _chunks(mask: int, shortest: int, min_words: int, shape: Signature | None):
    """Chunks and signature of each record; at a task's end its counts of chunks by slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        a, b = shape.multipliers() if shape else (None, None)
        counts = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = word_hashes(text, known)
                if ident is None or len(words) < max(1, min_words):
                    continue
                digests, lengths = chunk_record(words, mask, shortest)
                distinct, place = np.unique(digests, return_inverse=True)
                whole = (words * _powers(_BASE, len(words))).sum(dtype=np.uint64) ^ np.uint64(len(words))
                sig = signature_symbols(run_hashes(words, min(shape.width, len(words))), a, b).tobytes() if shape else None
                for out, x in zip(rows, (ident, int(whole.astype(np.int64)), len(words), distinct.view(np.int64), np.bincount(place, lengths).astype(np.int32), sig)):
                    out.append(x)
            if rows[3]:
                at, n = np.unique(_slots(np.concatenate(rows[3]).view(np.uint64)), return_counts=True)
                counts[at] += n.astype(np.uint32)
            yield _chunk_batch(*rows, *[[None] * len(rows[0])] * 2)
        if counts.any():
            blocks = np.minimum(counts, 65535).astype(np.uint16).reshape(-1, _BLOCK)
            n = len(blocks)
            yield _chunk_batch(*[[None] * n] * 6, list(range(n)), [x.tobytes() for x in blocks])

    return run


CHUNKS = "id long, print long, n_words int, digests array<long>, lengths array<int>, sig binary, block int, counts binary"


def _chunk_batch(*columns: list) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "print", "n_words", "digests", "lengths", "sig", "block", "counts"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            total[block] = total.get(block, 0) + np.frombuffer(counts, np.uint16).astype(np.int64)
    levels = [np.minimum(255, np.rint(8 * np.log2(1 + n))).astype(np.uint8).tobytes() for n in total.values()]
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(levels, pa.binary())], names=["block", "level"])


def slot_levels(table: DataFrame) -> np.ndarray:
    """How frequent what falls into each slot is, on a scale of logarithms. What reaches
    the driver are ``SLOTS`` bytes."""
    blocks = table.where("block IS NOT NULL").select("block", "counts").repartition("block").mapInArrow(_merged, "block int, level binary")
    levels = np.zeros(SLOTS, np.uint8).reshape(-1, _BLOCK)
    for r in blocks.collect():
        levels[r["block"]] = np.frombuffer(r["level"], np.uint8)
    return levels.reshape(-1)


def _rarest_first(digests: np.ndarray, levels: np.ndarray) -> np.ndarray:
    return np.lexsort((digests, levels[_slots(digests.view(np.uint64))]))


INDEX = "digest long, id long, side int, length int, need int"


def _chunk_index(min_overlap: float, mutual: bool, levels):
    """A record's chunks without the most frequent ones, and the words that a partner that
    reaches the fraction shares with it in these at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sides, ns = (batch.column(i).to_pylist() for i in range(3))
            keys: list[np.ndarray] = [np.empty(0, np.int64)]
            sizes: list[np.ndarray] = [np.empty(0, np.int32)]
            needs = []
            for side, n, digests, lengths in zip(sides, ns, batch.column(3), batch.column(4)):
                d, length = (np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in (digests, lengths))
                order = _rarest_first(d, levels.value)
                least = math.ceil(min_overlap * n - 1e-6)
                rest = np.cumsum(length[order][::-1])[::-1]
                kept = order if side & 1 and not mutual else order[rest >= LEFT_OUT * least]
                keys.append(d[kept])
                sizes.append(length[kept])
                needs.append(least - n + int(length[kept].sum()))
            n = np.array([len(k) for k in keys[1:]], np.int64)
            columns = np.concatenate(keys), np.repeat(np.array(ids, np.int64), n), np.repeat(np.array(sides, np.int32), n), np.concatenate(sizes).astype(np.int32), np.repeat(np.array(needs, np.int32), n)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["digest", "id", "side", "length", "need"])

    return run


def _fractions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What part of each record of a pair lies in chunks that both have."""
    for batch in batches:
        over: tuple[list[float], list[float]] = ([], [])
        for n_a, d_a, l_a, n_b, d_b, l_b in zip(*(batch.column(i) for i in range(3, 9))):
            a, la, b, lb = (x.values.to_numpy(zero_copy_only=False) for x in (d_a, l_a, d_b, l_b))
            over[0].append(float(la[np.isin(a, b)].sum()) / n_a.as_py())
            over[1].append(float(lb[np.isin(b, a)].sum()) / n_b.as_py())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *(pa.array(x, pa.float64()) for x in over)], names=["rep_a", "rep_b", "by_signature", "overlap_a", "overlap_b"])


@dataclass(frozen=True)
class Overlaps:
    """``members``: ``id, rep, side``; ``pairs``: ``rep_a, rep_b, overlap_a, overlap_b``
    between classes of equal records, ``rep_a = rep_b`` where a class is on both sides."""

    members: DataFrame
    pairs: DataFrame


def _across(index: DataFrame, mutual: bool) -> DataFrame:
    """``id_a, id_b`` of both sides whose common chunks in the index add up to what they need.
    The one index is shuffled once: what a side is, is asked of both rows together, so that no
    filter makes two plans of it. Nothing but numbers goes with a pair that meets."""
    a, b = (index.select("digest", *[F.col(c).alias(f"{c}_{x}") for c in ("id", "side", "length", "need")]) for x in "ab")
    sides = F.col("side_a").bitwiseAND(F.lit(1)) + F.col("side_b").bitwiseAND(F.lit(2))
    met = a.join(b, "digest").where((sides == 3) & (F.col("id_a") != F.col("id_b")))
    summed = met.groupBy("id_a", "id_b", "need_a", "need_b").agg(F.sum("length_a").alias("in_a"), F.sum("length_b").alias("in_b"))
    return summed.where((F.col("in_b") >= F.col("need_b")) & ((F.col("in_a") >= F.col("need_a")) | F.lit(not mutual))).select("id_a", "id_b")


def cross_split_overlap(records: DataFrame, sides: DataFrame, *, id_col: str = "id", text_col: str = "text", min_overlap: float = 0.2, mutual: bool = True, mask: int = 3, shortest: int = 3, min_words: int = 1, signature: Signature | None = None, threshold: float = 0.6) -> Overlaps:
    """Records of side ``a`` and of side ``b`` that share chunks of at least
    ``min_overlap`` of the record of side ``b``, and of that of side ``a`` too unless
    ``mutual`` is off. With ``signature`` also pairs that its join proposes for sets of
    runs with a Jaccard coefficient of ``threshold``, whatever their fractions.

    ``records`` has a unique id and a text, ``sides`` an ``id`` and a ``side``, 'a' or
    'b'; a record may be on both. A fraction is the total length of the record's chunks
    found in the other record, over its words. Records of equal words are one class,
    which is joined once however many they are. Records without words, an id or a side
    are in no pair; repeated rows of ``sides`` count once; texts are read whole; an
    empty side gives no pairs. Other columns are not read, whatever their names.
    """
    spark = records.sparkSession
    placed = sides.select(F.col("id").cast("long").alias("id"), "side").where(F.col("side").isin("a", "b")).distinct()
    texts = records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # each step leaves a table of pairs or of records; what it shuffled is gone before the next
    with shuffles_dropped(spark):
        written = stage_table(texts.mapInArrow(_chunks(mask, shortest, min_words, signature), CHUNKS), "chunks")
        levels = spark.sparkContext.broadcast(slot_levels(written))
        table = written.where("block IS NULL").select("id", "print", "n_words", "digests", "lengths", "sig")
        prints = placed.join(table.select("id", "print"), "id")
        classes = prints.groupBy("print").agg(F.min("id").alias("rep"))
        members = stage_table(prints.join(classes, "print").select("id", "rep", "side"), "members")
        on = members.groupBy(F.col("rep").alias("id")).agg(F.bit_or(F.when(F.col("side") == "a", 1).otherwise(2)).alias("side"))
        chunks = on.join(table, "id").select("id", "side", "n_words", "digests", "lengths").mapInArrow(_chunk_index(min_overlap, mutual, levels), INDEX)
        met = stage_table(_across(chunks, mutual), "met").withColumn("by_signature", F.lit(False))
        if signature:
            signed = on.join(table, "id").select(F.col("id").alias("rep"), "sig", "side")
            alike = stage_table(signature_pairs(signed, signature, threshold), "alike").withColumn("by_signature", F.lit(True))
            met = met.unionByName(alike).groupBy("id_a", "id_b").agg(F.bool_or("by_signature").alias("by_signature"))
    ca, cb = (table.select(*[F.col(x).alias(f"{x}_{s}") for x in ("id", "n_words", "digests", "lengths")]) for s in "ab")
    both = met.join(ca, "id_a").join(cb, "id_b").select("id_a", "id_b", "by_signature", *[f"{x}_{s}" for s in "ab" for x in ("n_words", "digests", "lengths")])
    shared = both.mapInArrow(_fractions, "rep_a long, rep_b long, by_signature boolean, overlap_a double, overlap_b double")
    near = shared.where(F.col("by_signature") | ((F.col("overlap_b") >= min_overlap) & ((F.col("overlap_a") >= min_overlap) | F.lit(not mutual)))).drop("by_signature")
    twice = on.where("side = 3").select(F.col("id").alias("rep_a"), F.col("id").alias("rep_b"), F.lit(1.0).alias("overlap_a"), F.lit(1.0).alias("overlap_b"))
    return Overlaps(members, near.unionByName(twice))


def member_pairs(found: Overlaps, pairs: DataFrame) -> DataFrame:
    """``id_a, id_b`` of different records in the given pairs of classes ``rep_a, rep_b``, with
    what other columns the pairs have; as large as a result of pairs demands."""
    m = found.members
    a = m.where("side = 'a'").select(F.col("rep").alias("rep_a"), F.col("id").alias("id_a"))
    b = m.where("side = 'b'").select(F.col("rep").alias("rep_b"), F.col("id").alias("id_b"))
    return pairs.join(a, "rep_a").join(b, "rep_b").where("id_a <> id_b").drop("rep_a", "rep_b")
