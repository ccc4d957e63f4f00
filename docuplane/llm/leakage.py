"""Passages of test items inside a training corpus, by a distributed positional index.

The terms of the index are runs of ``term`` adjacent words, whatever their number with the
same phrases; the longer they are, the shorter the lists. A posting is a term, a document
and a position. One scan of the corpus stores the postings of every term that
an item has. From them come the terms' counts in the whole corpus and all matches:

* Every window of ``passage`` words of an item is looked up by its rarest term; the
  list found is intersected, at the offset the item gives, with the list of the
  window's second rarest term, and where both meet, with those of all terms of the item
  on the same diagonal. Runs of consecutive positions are exact phrases, in full length.
* For proximity, in an index of shorter terms, the lists of the rarer half of an item's terms, and of the rarest near
  each position, are intersected within ``slop`` words: two terms that do not overlap,
  in the item's order, as far apart as in the item but for ``drift`` words.

Only terms that can occur in an item leave the scan. They are recognised by a bit map of
fixed size, whose chance hits no list of an item meets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docuplane.llm.shingles import WordHashes, mixed, word_hashes
from docuplane.session import stage_table

#: Bits of the map, a size that does not depend on the data: 8 MB.
MAP_BITS = 1 << 26
_BLOCK_BYTES = 1 << 16


def term_hashes(words: np.ndarray, term: int) -> np.ndarray:
    n = len(words) - term + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = words[:n].copy()
    for i in range(1, term):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + words[i : n + i])
    return h


POSTING = "term long, id long, pos int"


def _postings(term: int, bits=None):
    """Postings of each text's terms, of those in the bit map where one is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                h = term_hashes(word_hashes(text, known), term)
                at = _hits(h, bits.value) if bits is not None else np.arange(len(h))
                if len(at):
                    for x, v in zip(out, (h[at].view(np.int64), np.full(len(at), ident, np.int64), at.astype(np.int32))):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.empty(0, t)) for x, t in zip(out, (np.int64, np.int64, np.int32))], names=["term", "id", "pos"])

    return run


def _slot(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(8)) & np.uint64(MAP_BITS - 1)


def _map_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's bits, block after block; rows come sorted by block."""

    def closed(block: int, bits: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    block, bits = None, None
    for batch in batches:
        which, slot = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for b in np.unique(which):
            if b != block:
                if block is not None:
                    yield closed(block, bits)
                block, bits = int(b), np.zeros(_BLOCK_BYTES * 8, np.uint8)
            bits[slot[which == b]] = 1
    if block is not None:
        yield closed(block, bits)


def bit_map(keys: DataFrame) -> np.ndarray:
    """Bits of the slots of a column of hashes. What reaches the driver is a row a block, MAP_BITS bits in all."""
    slot = F.shiftrightunsigned(keys.columns[0], 8).bitwiseAND(F.lit(MAP_BITS - 1))
    per = _BLOCK_BYTES * 8
    rows = keys.select(F.floor(slot / per).cast("int").alias("block"), (slot % per).cast("int").alias("slot")).distinct()
    blocks = rows.repartition("block").sortWithinPartitions("block").mapInArrow(_map_blocks, "block int, bits binary")
    bits = np.zeros(MAP_BITS // 8, np.uint8).reshape(-1, _BLOCK_BYTES)
    for r in blocks.collect():
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(-1)


def _hits(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    s = _slot(h)
    return np.flatnonzero((bits[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & np.uint8(1))


def _kept(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(_hits(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits.value)))

    return run


def met_postings(index: DataFrame, wanted: DataFrame, *on: str) -> DataFrame:
    """``wanted`` joined with the postings it asks for. A bit map of what is asked for goes
    over the index first, so that only postings that are met, and few others, are shuffled."""
    key = (lambda: F.col(on[0])) if len(on) == 1 else (lambda: F.xxhash64(*on))
    bits = index.sparkSession.sparkContext.broadcast(bit_map(wanted.select(key().alias("key"))))
    near = index.select(key().alias("key"), "term", "id", "pos").mapInArrow(_kept(bits), f"key long, {POSTING}").drop("key")
    return wanted.join(near, list(on))


def _two_rarest(ranked: DataFrame, passage: int, term: int) -> DataFrame:
    """``item_id, pos, term, to_pos, to_term``: of every window of the item, all of whose terms
    the corpus has, the rarest term and the second rarest. Windows share most of theirs."""
    window = W.partitionBy("id").orderBy("pos").rowsBetween(0, passage - term)
    least = F.slice(F.array_sort(F.collect_list(F.struct("n", "pos", "term")).over(window)), 1, 2)
    best = ranked.select("id", least.alias("b"), F.count(F.lit(1)).over(window).alias("k")).where(F.col("k") == passage - term + 1).where("b[0].n > 0")
    second = F.coalesce(F.get("b", F.lit(1)), F.get("b", F.lit(0)))  # a passage of one term has no second
    return best.select(F.col("id").alias("item_id"), F.expr("b[0].pos").alias("pos"), F.expr("b[0].term").alias("term"), second["pos"].alias("to_pos"), second["term"].alias("to_term")).distinct()


def _phrases(index: DataFrame, ranked: DataFrame, passage: int, term: int) -> DataFrame:
    """``id, item_id, longest_run, first_pos`` of phrases of at least ``passage`` words."""
    pairs = stage_table(_two_rarest(ranked, passage, term).withColumnRenamed("pos", "item_pos"), "rarest-terms")
    shift = F.col("pos") - F.col("item_pos")
    first = met_postings(index, pairs, "term").select("id", "item_id", shift.alias("shift"), F.col("to_term").alias("term"), (shift + F.col("to_pos")).alias("pos"))
    diagonals = stage_table(met_postings(index, stage_table(first, "rarest-lists"), "term", "id", "pos").select("id", "item_id", "shift").distinct(), "diagonals")
    every = ranked.where("n > 0").select(F.col("id").alias("item_id"), "term", F.col("pos").alias("item_pos"))
    points = diagonals.join(every, "item_id").select("id", "item_id", "shift", "term", "item_pos", (F.col("item_pos") + F.col("shift")).alias("pos"))
    on = met_postings(index, points, "term", "id", "pos").select("id", "item_id", "shift", "item_pos", "pos").distinct()
    along = W.partitionBy("id", "item_id", "shift").orderBy("item_pos")
    runs = on.withColumn("run", F.col("item_pos") - F.row_number().over(along)).groupBy("id", "item_id", "shift", "run").agg((F.count(F.lit(1)) + term - 1).alias("words"), F.min("pos").alias("from"))
    return runs.where(F.col("words") >= passage).groupBy("id", "item_id").agg(F.max("words").alias("longest_run"), F.min("from").alias("first_pos"))


def _near(index: DataFrame, ranked: DataFrame, passage: int, term: int, slop: int, drift: int) -> DataFrame:
    """``id, item_id, first_pos`` where two rare terms of the item stand close to each other."""
    have = ranked.withColumn("k", F.count(F.lit(1)).over(W.partitionBy("id"))).where((F.col("k") >= passage - term + 1) & (F.col("n") > 0))
    bars = have.select("id", "term", "n").distinct().groupBy("id").agg(F.when(F.count(F.lit(1)) > 2, F.percentile("n", F.lit(0.5))).otherwise(F.max("n")).alias("bar"))
    rare = have.join(bars, "id").where(F.col("n") <= F.col("bar")).select(F.col("id").alias("item_id"), "term", "pos")
    # by position, so that windows may hold terms that the corpus lacks
    least = F.min(F.struct("n", "pos", "term")).over(W.partitionBy("id").orderBy("pos").rangeBetween(0, passage - term))
    beside = have.select("id", least.alias("b")).select(F.col("id").alias("item_id"), F.col("b.term").alias("term"), F.col("b.pos").alias("pos"))
    chosen = rare.unionByName(beside).distinct()
    met = met_postings(index, stage_table(chosen.withColumnRenamed("pos", "item_pos"), "rare-terms"), "term").withColumn("shift", F.col("pos") - F.col("item_pos"))
    # two postings within the drift that are no overlap: else the pair is out before any postings are compared
    by_shift = W.partitionBy("id", "item_id").orderBy("shift").rangeBetween(0, drift)
    apart = F.greatest(F.col("pos") - F.min("pos").over(by_shift), F.max("pos").over(by_shift) - F.col("pos"))
    open_ = met.select("id", "item_id", "pos", "shift", (apart >= term).alias("apart")).withColumn("open", F.max("apart").over(W.partitionBy("id", "item_id"))).where("open")
    blocks = open_.select("id", "item_id", "pos", "shift", F.floor(F.col("pos") / slop).alias("block")).distinct()
    other = blocks.select("id", "item_id", F.explode(F.array(F.col("block"), F.col("block") + 1)).alias("block"), F.col("pos").alias("before"), F.col("shift").alias("was"))
    close = blocks.join(other, ["id", "item_id", "block"]).where((F.col("pos") - F.col("before")).between(term, slop) & (F.abs(F.col("shift") - F.col("was")) <= drift) & (F.col("pos") - F.col("shift") > F.col("before") - F.col("was")))
    return close.groupBy("id", "item_id").agg(F.min("before").alias("first_pos"))


def positional_index(docs: DataFrame, tests: DataFrame, term: int) -> tuple[DataFrame, DataFrame]:
    """The postings ``term, id, pos`` of all documents' terms that an item has, and the items'
    terms ``term, id, pos, n`` with their numbers of postings."""
    item_terms = stage_table(tests.mapInArrow(_postings(term), POSTING), "item-terms")
    bits = docs.sparkSession.sparkContext.broadcast(bit_map(item_terms.select("term")))
    index = stage_table(docs.mapInArrow(_postings(term, bits), POSTING), "positional-index")
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    ranked = item_terms.distinct().join(counts, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return index, stage_table(ranked, "ranked-terms")


def leaked_passages(documents: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", passage: int = 12, term: int = 6, near_term: int = 3, slop: int = 40, drift: int | None = None, proximity: bool = True) -> DataFrame:
    """``doc_id, item_id, kind, longest_run, first_pos``: documents that hold passages of items.

    ``kind`` is 'phrase' where at least ``passage`` consecutive words of the item occur;
    ``longest_run`` counts all of them. Else it is 'proximity', where two rare terms of
    the item, of ``near_term`` words, that do not overlap occur within ``slop`` words, in the item's order, and as
    far apart as in the item but for ``drift`` words (``slop`` unless given). Rare are the item's terms up to its
    median count, of those that the corpus has, two at least, and the rarest near each
    position. Without ``proximity`` only phrases come out. Words are unbroken runs of
    letters and digits, case ignored, so punctuation, quotes and line breaks do not
    matter. An item shorter than a passage, null or empty, leaks nowhere. Repeated rows
    and equal ids count once in the result; rows without an id take no part; texts are
    read whole. Empty tables give no rows. Other columns are not read, whatever their
    names.
    """
    docs = documents.select(F.col(doc_id).cast("long").alias("id"), F.col(doc_text).cast("string").alias("text")).dropna()
    tests = items.select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).dropna().distinct()
    term = min(term, passage)
    found = stage_table(_phrases(*positional_index(docs, tests, term), passage, term), "phrases")
    exact = found.select(F.col("id").alias("doc_id"), "item_id", F.lit("phrase").alias("kind"), F.col("longest_run").cast("int").alias("longest_run"), "first_pos")
    if not proximity:
        return exact
    near_term = min(near_term, passage)
    near = _near(*positional_index(docs, tests, near_term), passage, near_term, slop, slop if drift is None else drift).join(found.select("id", "item_id"), ["id", "item_id"], "left_anti")
    return exact.unionByName(near.select(F.col("id").alias("doc_id"), "item_id", F.lit("proximity").alias("kind"), F.lit(None).cast("int").alias("longest_run"), "first_pos"))
