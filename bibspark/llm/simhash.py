"""SimHash near-dedup with pigeonring filtering.

The 64-bit fingerprint is cut into three consecutive segments in a ring. If two fingerprints
differ in at most 2 bits, then some segment starts a chain whose cumulative differences stay
within the proportional budgets floor(l * 2 / 3) of its first l segments: 0, 1 and 2. So the first
segment is equal and the next differs in at most one bit, hence agrees on one of its halves: the
join key is a segment with one half of the next, six keys a fingerprint. Candidates must pass the
chain test before the full Hamming check. Equal fingerprints are one class from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from bibspark.llm import common as c

MAX_BITS = 2
SHINGLE = 3
SEED = 42
#: First bit and width of the three segments.
SEGMENTS = ((0, 21), (21, 21), (42, 22))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a lower-cased text: majority bits of its shingles' XXH64."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[:-1]])
        hashes = [xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    h = np.array(hashes, c.U64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(c.U64)[0])


def row_key():
    """Tells rows apart by doc_id and text."""
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text").cast("string"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, row_key, fp (the 64 bits as a signed long)."""

    def run(batches):
        for batch in batches:
            ids, offs, buf = c.batch_texts(batch)
            data = buf.tobytes()
            fps = np.array([fingerprint(data[offs[k] : offs[k + 1]]) for k in range(len(ids))], c.U64)
            yield pa.RecordBatch.from_arrays([c.id_array(ids), batch.column(2), pa.array(fps.view(np.int64))], ["doc_id", "row_key", "fp"])

    three = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row_key"))
    return three.mapInArrow(run, "doc_id long, row_key long, fp long")


def _segment(fp, k: int):
    at, width = SEGMENTS[k]
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Distinct fingerprints (fp) -> all pairs (a < b) that differ in at most max_bits (<= 2) bits."""
    if not 0 <= max_bits <= 2:
        raise ValueError("three segments serve up to 2 bits")
    fp = F.col("fp")
    keys = []
    for k in range(3):
        width = SEGMENTS[(k + 1) % 3][1]
        nxt, low = _segment(fp, (k + 1) % 3), width // 2
        for half, part in enumerate((nxt.bitwiseAND(F.lit((1 << low) - 1)), F.shiftright(nxt, low))):
            keys.append(F.struct(F.lit(2 * k + half).cast("byte").alias("slot"), F.shiftleft(_segment(fp, k), 11).bitwiseOR(part).alias("key")))
    index = fps.select("fp", F.inline(F.array(*keys)))
    diff = F.col("a").bitwiseXOR(F.col("b"))
    d = [F.bit_count(_segment(diff, k)) for k in range(3)]
    chain = F.lit(False)
    for k in range(3):
        chain = chain | ((F.floor(F.col("slot") / 2) == k) & (d[k] == 0) & (d[k] + d[(k + 1) % 3] <= 1) & (d[k] + d[(k + 1) % 3] + d[(k + 2) % 3] <= 2))
    left = index.withColumnRenamed("fp", "a")
    right = index.withColumnRenamed("fp", "b")
    return (
        left.join(right, ["slot", "key"])
        .where("a < b")
        .where(chain)
        .where(F.bit_count(diff) <= max_bits)
        .select("a", "b")
        .distinct()
    )


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs (doc_id, text, more) -> doc_id, row_key, fp, component_id (smallest doc_id reachable by
    links) and keep_key (the row_key of one row of the component, of the smallest doc_id).

    A null or blank text has fingerprint zero and links like any other; a null doc_id keeps its
    row but names a component only if that holds no other; repeated rows stay.
    """
    own = c.materialize(fingerprints(docs))
    return linked(own, links(own.select("fp").distinct(), max_bits))


def linked(own: DataFrame, edges: DataFrame) -> DataFrame:
    """own (doc_id, row_key, fp) with component_id and keep_key of the components of edges (a, b)
    between fps."""
    least = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "row_key"))
    classes = c.materialize(own.groupBy("fp").agg(least.alias("low")))
    roots = c.components(edges)
    named = classes.join(roots, classes.fp == roots.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("root"))
    lows = named.groupBy("root").agg(F.min("low").alias("least"))
    ids = named.join(lows, "root").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.row_key").alias("keep_key"))
    return own.join(ids, "fp").select("doc_id", "row_key", "fp", "component_id", "keep_key")


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each component, all columns kept; see keep_first."""
    return keep_first(docs, near_duplicates(docs, max_bits))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with one row of each component of found (doc_id, row_key, component_id, keep_key): that
    of the smallest doc_id, null only where a component holds no other. Columns are unchanged,
    whatever their names. Rows that share doc_id and text are copies of which one stays."""
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row_key") == F.col("keep_key")))
    keep = keep.select(_keep_key(F.col("doc_id"), F.col("row_key")).alias("key")).distinct()
    rows = docs.select(F.struct("*").alias("row"), _keep_key(F.col("doc_id").cast("long"), row_key()).alias("key")).join(keep, "key")
    one = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    return rows.withColumn("one", one).where("one = 1").select("row.*")


def _keep_key(doc_id, key):
    return F.concat_ws(" ", F.coalesce(doc_id.cast("string"), F.lit("n")), key.cast("string"))


def op9_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and their components at 2 or fewer differing bits."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
