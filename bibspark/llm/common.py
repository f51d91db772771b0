"""Helpers shared by the operators: shared storage, text blocks, packed integers, components."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import uuid
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text in one block, and of packed rows meant for one bucket.
BLOCK_BYTES = 4 << 20
#: Stands for a null id inside blocks; it sorts after every other id.
NULL_ID = np.iinfo(np.int64).max
U64 = np.uint64
#: Odd bases of the polynomial hashes modulo 2**64; later ones serve when a collision is seen.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5)

_made: list[tuple[SparkSession, str]] = []


# ---------------------------------------------------------------- shared storage
def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where it is unset, a session on one machine gets a
    folder of its own; on a cluster executors would not share one, so that is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not context_dir.isDefined() and not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = context_dir.get() if context_dir.isDefined() else "file:///tmp/checkpoints/bibspark"
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/bibspark-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: lineage ends here, on storage
    that outlives any executor."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of materialize() that nothing will read again, and lets go of the shuffle
    files behind them."""
    for df in tables:
        if _delete(df.sparkSession, df._shared_path):
            _made.remove((df.sparkSession, df._shared_path))
    gc.collect()
    if tables:
        tables[0].sparkSession.sparkContext._jvm.java.lang.System.gc()


def _delete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended before
            return


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def buckets(spark: SparkSession, n_bytes: int, for_each: int = 3) -> int:
    """A power of two that grows with the data: about BLOCK_BYTES of text each, and enough of
    them that every shuffle partition gets some."""
    need = max(n_bytes // BLOCK_BYTES + 1, for_each * partitions(spark))
    return 1 << int(need - 1).bit_length()


def trim() -> None:
    """Gives what a worker has freed back to the system; without it the large arrays of one stage stay
    in the worker while the next one runs. Does nothing where the C library has no such call."""
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        return


# ---------------------------------------------------------------- packed integers
def enc(a: np.ndarray, delta: bool = False) -> bytes:
    """Byte planes under zstd; delta for sorted input."""
    if delta and len(a):
        a = np.diff(a, prepend=a.dtype.type(0))
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def dec(b: bytes, dtype, delta: bool = False) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    size = np.dtype(dtype).itemsize
    a = np.ascontiguousarray(raw.reshape(size, -1).T).reshape(-1).view(dtype)
    return np.cumsum(a, dtype=dtype) if delta else a


def zip_bytes(b, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(b)


def unzip_bytes(b) -> bytes:
    return zstandard.ZstdDecompressor().decompress(b)


# ---------------------------------------------------------------- hashing kernels
_pow_cache: dict[tuple[int, int], np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    key = (base, 0)
    have = _pow_cache.get(key)
    if have is None or len(have) < n:
        if len(_pow_cache) > 8:
            _pow_cache.clear()
        steps = np.full(max(n, 1 << 16), base, U64)
        steps[0] = 1
        have = _pow_cache[key] = np.cumprod(steps, dtype=U64)
    return have[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads polynomial hashes over all 64 bits (finaliser of SplitMix64)."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_hash(values: np.ndarray, base: int) -> np.ndarray:
    """h[i] = sum of (values[j] + 1) * base**j over j < i, modulo 2**64."""
    h = np.empty(len(values) + 1, U64)
    h[0] = 0
    np.cumsum((values.astype(U64) + U64(1)) * powers(base, len(values)), out=h[1:])
    return h


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs without ASCII white space; none crosses a document), and
    for each document the index of its first word (one more at the end)."""
    n = len(buf)
    space = SPACE[buf]
    first = np.empty(n, bool)
    last = np.empty(n, bool)
    if n:
        first[0] = True
        first[1:] = space[:-1]
        last[-1] = True
        last[:-1] = space[1:]
        inner = offs[(offs > 0) & (offs < n)]
        first[inner] = True
        last[inner - 1] = True
    starts = np.flatnonzero(first & ~space)
    ends = np.flatnonzero(last & ~space) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of a cryptographic digest of each word of word_spans(). The distinct words of the buffer
    are told apart as they are, byte by byte, so that each is digested once. No words can be made up to
    share a digest, as they can for polynomial hashes modulo 2**64."""
    if not len(starts):
        return np.zeros(0, U64)
    letters = ~SPACE[buf]
    before = np.cumsum(letters, dtype=np.int64)
    bounds = np.append(before[starts] - 1, before[-1])
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(buf[letters].tobytes())]).dictionary_encode()
    digests = b"".join(blake2b(w, digest_size=8).digest() for w in words.dictionary.to_pylist())
    return np.frombuffer(digests, U64)[words.indices.to_numpy()]


# ---------------------------------------------------------------- text blocks
BLOCK_SCHEMA = "block long, n_docs long, n_bytes long, ids binary, sizes binary, data binary"


def batch_texts(batch: pa.RecordBatch, id_col: str = "doc_id", text_col: str = "text"):
    """ids (null: NULL_ID), offsets and bytes of a batch; a null text is empty."""
    ids = batch.column(batch.schema.get_field_index(id_col)).cast(pa.int64())
    ids = ids.fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
    texts = batch.column(batch.schema.get_field_index(text_col)).cast(pa.large_string()).fill_null("")
    texts = pa.concat_arrays([texts])
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64, len(texts) + 1 + texts.offset)[texts.offset :] if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return ids, offs - offs[0], buf[offs[0] : offs[-1]]


def text_chunks(batches, target: int = BLOCK_BYTES):
    """Yields (ids, offs, buf) of about `target` bytes; a longer document is a chunk of its own."""
    ids, sizes, bufs, total = [], [], [], 0

    def out():
        lens = np.concatenate(sizes)
        return np.concatenate(ids), np.concatenate([[0], np.cumsum(lens)]).astype(np.int64), np.concatenate(bufs)

    for batch in batches:
        i, o, b = batch_texts(batch)
        at = 0
        while at < len(i):
            end = max(at + 1, int(np.searchsorted(o, o[at] + target - total, side="right")) - 1)
            if total and o[end] - o[at] > target - total:
                end = at
            if end > at:
                ids.append(i[at:end])
                sizes.append(np.diff(o[at : end + 1]))
                bufs.append(b[o[at] : o[end]])
                total += int(o[end] - o[at])
                at = end
            if at < len(i) or total >= target:
                yield out()
                ids, sizes, bufs, total = [], [], [], 0
    if ids:
        yield out()


def pack_blocks(docs: DataFrame, target: int = BLOCK_BYTES) -> DataFrame:
    """Documents (doc_id, text) as compressed blocks in the shared folder. Blocks take the place of
    documents in shuffles: a few large rows, and what answers a block needs no row per document."""

    def pack(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for seq, (ids, offs, buf) in enumerate(text_chunks(batches, target)):
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([(part << 32) + seq], pa.int64()),
                    "n_docs": pa.array([len(ids)], pa.int64()),
                    "n_bytes": pa.array([len(buf)], pa.int64()),
                    "ids": [enc(ids)],
                    "sizes": [enc(np.diff(offs))],
                    "data": [zip_bytes(buf.tobytes(), 4)],
                }
            )

    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialize(two.mapInArrow(pack, BLOCK_SCHEMA), "uncompressed")


def open_block(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, offsets and bytes of a block row."""
    sizes = dec(row["sizes"], np.int64)
    offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return dec(row["ids"], np.int64), offs, np.frombuffer(unzip_bytes(row["data"]), np.uint8)


def total_bytes(blocks: DataFrame) -> int:
    return int(blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0])


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NULL_ID)


def hex_array(digests: list[str]) -> pa.Array:
    return pa.array(digests, pa.string())


# ---------------------------------------------------------------- connected components
def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a long, b long) -> (node, component): the smallest node reachable. Alternates the
    large-star and small-star steps of Kiveris et al. (2014); every step is a grouped minimum and
    a join, so that a node with many neighbours is pre-aggregated and its join can be split.
    Each round is written to the shared folder. Nodes without edges are not returned."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = both.join(low, "u")
        if large:
            out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a > b").distinct()

    def mark(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.col("b").cast("decimal(38,0)")), F.sum(F.hash("a", "b").cast("long"))).first()
        return tuple(r)

    e = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    was = mark(e)
    for _ in range(max_rounds):
        if not was[0]:
            break
        before, e = e, materialize(star(star(e, True), False))
        discard(before)
        now = mark(e)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not converge")
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
