"""Best-fit packing under conflicts.

Documents are cut into pieces of at most `capacity` words and the pieces go into bins. No bin holds
two pieces of one duplicate cluster (equal texts, or a given column), nor of one source. Bins carry
a bitmap of their sources and one of their clusters, and stand in the order of their residual
capacity; a piece, largest first, starts at the smallest residual that holds it and goes from
successor to successor until the tightest compatible bin is found, else opens a new one.

Documents are dealt to shards at random, whatever their source or cluster; a shard holds about
`shard_docs` documents, is packed on its own, and only ids, sizes and labels travel, never texts.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import materialize
from bibspark.llm.mixing import word_count

CAPACITY = 1024
SHARD_DOCS = 2048
SCHEMA = "doc_id long, piece int, start_word long, n_words long, bin_id string, position int, source string, cluster long"


def best_fit(pieces, capacity: int):
    """pieces (size, source, cluster), largest first -> the bin of each. Bitmaps are integers, one
    bit for each source or cluster of the shard."""
    bins: list[list[int]] = []  # [source bitmap, cluster bitmap]
    residuals: list[tuple[int, int]] = []  # (residual, bin), sorted
    source_bits: dict = {}
    cluster_bits: dict = {}
    out = []
    for size, source, cluster in pieces:
        s = 1 << source_bits.setdefault(source, len(source_bits))
        d = 1 << cluster_bits.setdefault(cluster, len(cluster_bits))
        at = bisect_left(residuals, (size, -1))
        while at < len(residuals):
            b = bins[residuals[at][1]]
            if not b[0] & s and not b[1] & d:
                break
            at += 1
        if at < len(residuals):
            left, k = residuals.pop(at)
            bins[k][0] |= s
            bins[k][1] |= d
        else:
            left, k = capacity, len(bins)
            bins.append([s, d])
        if left > size:
            insort(residuals, (left - size, k))
        out.append(k)
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_docs: int = SHARD_DOCS, cluster: str | None = None) -> DataFrame:
    """docs (doc_id, text, source, more) -> a row for each piece: doc_id, piece, start_word,
    n_words, bin_id, position (place in the bin), source, cluster.

    Every word of every document is in exactly one piece. Texts that are null or without words give
    one piece of size 0, so no row is lost. A null source is a source; without `cluster`, equal
    texts are a cluster (null with null). Repeated rows are documents of one cluster. Columns of
    docs with the names made here are not used; an empty table gives an empty result.
    """
    if capacity < 1 or shard_docs < 1:
        raise ValueError("capacity and shard_docs must be positive")
    label = F.xxhash64(F.coalesce("text", F.lit(""))) if cluster is None else F.xxhash64(F.col(cluster))
    small = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), label.alias("cluster"), word_count(F.col("text")).alias("size")))
    shards = max(1, -(-small.count() // shard_docs))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = []
        for doc_id, source, group, size in zip(pdf["doc_id"].astype("Int64"), pdf["source"], pdf["cluster"], pdf["size"], strict=True):
            source = None if pd.isna(source) else source
            for k in range(max(1, -(-size // capacity))):
                pieces.append((min(capacity, size - k * capacity), source, group, doc_id, k))
        pieces.sort(key=lambda p: (-p[0], p[3] is pd.NA, 0 if p[3] is pd.NA else p[3], p[4], p[2]))
        found = best_fit([p[:3] for p in pieces], capacity)
        filled: dict[int, int] = {}
        shard = int(pdf["shard"].iloc[0])
        rows = []
        for p, b in zip(pieces, found, strict=True):
            position = filled[b] = filled.get(b, -1) + 1
            rows.append((p[3], p[4], p[4] * capacity, p[0], f"{shard}-{b}", position, p[1], p[2]))
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "start_word", "n_words", "bin_id", "position", "source", "cluster"])
        return out.astype({"doc_id": "Int64"})

    dealt = small.withColumn("shard", F.pmod(F.xxhash64(F.lit("pack"), "doc_id", "size"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, SCHEMA)


def op8_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents into bins of 1024 words."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
