"""A training mix with target shares, by systematic sampling.

A source's rate, the expected copies of each of its documents, follows from its size in
tokens, its target share and its cap. The expected copies are prefix-summed within the
source, a random offset is added once, and a document is emitted once for each integer
boundary its interval crosses; so it comes floor(rate) or ceil(rate) times, never more
often than its cap, and the total is off by less than one document. Documents are
summed in order of size, which spreads every size evenly and keeps the tokens on target
as well.

The prefix sum is two-level: blocks of similar size and equal hash within a source are
summed by an aggregate, blocks are prefix-summed, and each block is summed by itself. A
source may thus hold most of the rows; no task ever reads a whole source.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docuplane.session import stage_table

#: Copies are counted in integer parts, so that sums do not depend on their order.
PARTS = 1 << 24


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixture", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _token_counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            encode = _encoding(path).encode_ordinary
            n = [len(encode(t)) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["id", "source", "n_tokens"])

    return run


def token_counts(documents: DataFrame, *, doc_id: str, text: str, source: Column, tokenizer: str) -> DataFrame:
    """``id, source, n_tokens`` over whole texts; null and empty texts have no tokens.

    ``tokenizer``: the path of a public ranks file, readable on every executor."""
    rows = documents.select(F.col(doc_id).cast("long").alias("id"), source.alias("source"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(_token_counts(tokenizer), "id long, source string, n_tokens long")


def mixing_rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """``source, share, max_repeats, size, rate`` of each target source.

    Without ``total_tokens`` the mix is the largest in which every source that is
    present meets its share within its cap; shares of absent sources are divided among
    the others in proportion. With it, a source that cannot supply its share gives all
    its cap allows. ``targets`` has ``source, target_share, max_repeats``, a row a
    source; the window below runs over those rows only.
    """
    t = targets.groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    known = t.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    every = W.partitionBy(F.lit(0))
    usable = (F.col("size") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    shares = known.withColumn("share", F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(every)))
    whole = F.lit(float(total_tokens)) if total_tokens is not None else F.min(F.col("max_repeats") * F.col("size") / F.col("share")).over(every)
    rate = F.least(F.col("max_repeats").cast("double"), F.col("share") * whole / F.col("size"))
    return shares.select("source", "target_share", "share", "max_repeats", "size", F.when(F.col("share").isNotNull(), rate).otherwise(0.0).alias("rate"))


def systematic_copies(counts: DataFrame, rates: DataFrame, *, seed: int = 7, buckets: int = 64) -> DataFrame:
    """``id, source, n_tokens, copies`` of every counted document of a target source."""
    rate = rates.select("source", F.floor(F.col("rate") * PARTS).cast("long").alias("parts"))
    rows = counts.join(rate, "source").select(
        "id", "source", "n_tokens", "parts", F.floor(F.log2(F.col("n_tokens") + 1.0) * 4).cast("int").alias("b1"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(buckets)).cast("int").alias("b2")
    )
    blocks = rows.groupBy("source", "b1", "b2").agg(F.sum("parts").alias("total"))
    before = W.partitionBy("source").orderBy("b1", "b2").rowsBetween(W.unboundedPreceding, -1)
    offset = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(PARTS))
    starts = blocks.select("source", "b1", "b2", (F.coalesce(F.sum("total").over(before), F.lit(0)) + offset).alias("start"))
    inside = W.partitionBy("source", "b1", "b2").orderBy("n_tokens", "id").rowsBetween(W.unboundedPreceding, 0)
    ends = rows.withColumn("upto", F.sum("parts").over(inside)).join(starts, ["source", "b1", "b2"])
    crossed = F.expr(f"((start + upto) div {PARTS}L) - ((start + upto - parts) div {PARTS}L)")
    return ends.select("id", "source", "n_tokens", crossed.cast("int").alias("copies"))


def mixed_copies(documents: DataFrame, targets: DataFrame, *, doc_id: str, text: str, source: Column, target_source: Column, tokenizer: str, total_tokens: int | None = None, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """The mix ``id, source, n_tokens, copies`` (with copies above 0), and its report
    ``source, target_share, actual_share, rate, n_documents, n_copies, tokens``.

    Ids are unique. A document without a source, or of one that is no target, is left
    out; texts of no tokens are copied at their source's rate like others. A source
    absent from the documents is reported with a share of 0. Equal sizes are ordered by
    id. Empty documents give an empty mix, empty targets an empty report.
    """
    aims = targets.select(target_source.alias("source"), "target_share", "max_repeats").where(F.col("source").isNotNull())
    counts = stage_table(token_counts(documents, doc_id=doc_id, text=text, source=source, tokenizer=tokenizer).where(F.col("source").isNotNull()), "token-counts")
    rates = stage_table(mixing_rates(counts.groupBy("source").agg(F.sum("n_tokens").alias("size")), aims, total_tokens), "rates")
    mix = systematic_copies(counts, rates, seed=seed).where("copies > 0")
    got = mix.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    report = rates.join(got, "source", "left").select(
        "source",
        "target_share",
        F.coalesce(F.try_divide(F.col("tokens"), F.sum("tokens").over(W.partitionBy(F.lit(0)))), F.lit(0.0)).alias("actual_share"),
        "rate",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_documents", "n_copies", "tokens")],
    )
    return mix, report
