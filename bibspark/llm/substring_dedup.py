"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Documents become blocks. Each block hashes all its windows (a polynomial over the words' digests modulo
2**64, by prefix sums), keeps each distinct hash once with the smallest doc_id that holds it, and
sends the sorted hashes, packed, to the bucket of their leading bits. A bucket finds for each hash
the smallest doc_id of all and answers each block with one bit per hash: does it start in a
document with a smaller doc_id than the block's smallest? The block, hashed again, marks the words
that repeated windows cover; overlapping windows merge into maximal removal intervals.

A passage that a third of all documents share costs one packed hash per block and window, whatever
the number of documents. Windows are told apart by 64 bits; two of n different windows fall
together with probability n**2 / 2**65 (6e-4 for 1.5e8 windows).
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm import common as c

WINDOW = 13
SENT = "bucket int, block long, hashes binary, ids binary"
ANSWER = "block long, bucket int, n long, bits binary"
RESULT = "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"


def window_hashes(buf, offs, window: int):
    """For each window: its hash, the index of its first word and of its document; and the index
    of each document's first word."""
    starts, ends, first = c.word_spans(buf, offs)
    base = c.BASES[1]
    h = c.prefix_hash(c.word_hashes(buf, starts, ends), base)
    n = len(starts)
    if n < window:
        return np.zeros(0, c.U64), np.zeros(0, np.int64), np.zeros(0, np.int64), first
    doc = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    at = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
    w = (h[at + window] - h[at]) * c.powers(c.inverse(base), n + 1)[at]
    return c.mix(w), at, doc[at], first


def distinct(hashes, ids):
    """Sorted distinct hashes, the smallest id of each, and each input's place among them."""
    order = np.argsort(hashes, kind="stable")
    s = hashes[order]
    new = np.empty(len(s), bool)
    new[:1] = True
    np.not_equal(s[1:], s[:-1], out=new[1:])
    at = np.flatnonzero(new)
    place = np.empty(len(s), np.int64)
    place[order] = np.cumsum(new) - 1
    return s[at], (np.minimum.reduceat(ids[order], at) if len(at) else ids[:0]), place


def bucket_bounds(keys, bits: int):
    """Where each bucket (leading bits) begins in sorted keys."""
    tops = np.arange(1, 1 << bits, dtype=c.U64) << c.U64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, tops), [len(keys)]])


def dedup_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs (doc_id, text, more) -> doc_id, n_words, n_removed, n_spans, kept_sha256 and the removed
    spans as word intervals [start, end).

    A null text has no words; a null doc_id counts as larger than all others; rows that share a
    doc_id do not remove each other's words; documents under `window` words stay whole; more
    columns of docs are not used. An empty table gives an empty result.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    blocks = c.pack_blocks(docs)
    bits = c.buckets(docs.sparkSession, c.total_bytes(blocks)).bit_length() - 1

    def send(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, offs, buf = c.open_block(row)
                hashes, _, doc, _ = window_hashes(buf, offs, window)
                keys, low, _ = distinct(hashes, ids[doc])
                own, codes = np.unique(low, return_inverse=True)
                at = bucket_bounds(keys, bits)
                full = np.flatnonzero(np.diff(at))
                small = np.uint16 if len(own) < 1 << 16 else np.uint32
                out = {"bucket": [], "block": [], "hashes": [], "ids": []}
                for b in full:
                    part = slice(at[b], at[b + 1])
                    code = codes[part].astype(small)
                    head, inner = np.unique(code, return_inverse=True)
                    packed = c.enc(own[head], delta=True)
                    out["bucket"].append(int(b))
                    out["block"].append(row["block"])
                    out["hashes"].append(c.enc(keys[part], delta=True))
                    out["ids"].append(len(packed).to_bytes(4, "little") + packed + bytes([np.dtype(small).itemsize]) + c.enc(inner.astype(small)))
                yield pa.RecordBatch.from_pydict(out, schema=sent_schema)

    sent_schema = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("ids", pa.binary())])

    def judge(table):
        rows = table.to_pylist()
        hashes, ids = [], []
        for row in rows:
            hashes.append(c.dec(row["hashes"], c.U64, delta=True))
            n = int.from_bytes(row["ids"][:4], "little")
            head = c.dec(row["ids"][4 : 4 + n], np.int64, delta=True)
            kind = np.uint16 if row["ids"][4 + n] == 2 else np.uint32
            ids.append(head[c.dec(row["ids"][5 + n :], kind)])
        every, own = np.concatenate(hashes), np.concatenate(ids)
        _, low, place = distinct(every, own)
        repeated = low[place] < own
        ends = np.cumsum([len(h) for h in hashes])
        return pa.table(
            {
                "block": pa.array([r["block"] for r in rows], pa.int64()),
                "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
                "n": pa.array([len(h) for h in hashes], pa.int64()),
                "bits": pa.array([c.zip_bytes(np.packbits(repeated[e - len(h) : e]).tobytes(), 1) for e, h in zip(ends, hashes, strict=True)], pa.binary()),
            }
        )

    def finish(block, answers):
        tables = [result_schema.empty_table()]
        flags = [
            np.unpackbits(np.frombuffer(c.unzip_bytes(a["bits"]), np.uint8), count=a["n"])
            for a in sorted(answers.to_pylist(), key=lambda a: a["bucket"])
        ]
        flags = np.concatenate(flags).astype(bool) if flags else np.zeros(0, bool)
        for row in block.to_pylist():
            ids, offs, buf = c.open_block(row)
            hashes, at, doc, first = window_hashes(buf, offs, window)
            keys, low, place = distinct(hashes, ids[doc])
            hit = flags[place] | (ids[doc] > low[place]) if len(keys) else np.zeros(0, bool)
            edge = np.zeros(first[-1] + 1, np.int32)
            np.add.at(edge, at[hit], 1)
            np.add.at(edge, at[hit] + window, -1)
            gone = np.cumsum(edge)[:-1] > 0
            tables.append(kept_words(ids, offs, buf, first, gone))
        return pa.concat_tables(tables)

    answers = blocks.mapInArrow(send, SENT).groupBy("bucket").applyInArrow(judge, ANSWER)
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, RESULT)


result_schema = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


def runs(mask: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs in mask, none across a bound; and for each bound the
    number of runs before it."""
    n = len(mask)
    begin, end = mask.copy(), mask.copy()
    if n:
        begin[1:] &= ~mask[:-1]
        end[:-1] &= ~mask[1:]
        inner = bounds[(bounds > 0) & (bounds < n)]
        begin[inner] |= mask[inner]
        end[inner - 1] |= mask[inner - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, bounds)


def span_lists(starts, ends, before, bounds) -> pa.Array:
    base = np.repeat(bounds[:-1], np.diff(before))
    both = pa.StructArray.from_arrays([pa.array((starts - base).astype(np.int32)), pa.array((ends - base).astype(np.int32))], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), both)


def kept_words(ids, offs, buf, first, gone) -> pa.Table:
    data = buf.tobytes()
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[first[1:]] - total[first[:-1]]
    digests = []
    for k in range(len(ids)):
        words = data[offs[k] : offs[k + 1]].split()
        if removed[k]:
            words = compress(words, (~gone[first[k] : first[k + 1]]).tolist())
        digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
    starts, ends, before = runs(gone, first)
    return pa.table(
        [c.id_array(ids), pa.array(np.diff(first), pa.int64()), pa.array(removed, pa.int64()), pa.array(np.diff(before), pa.int64()), c.hex_array(digests), span_lists(starts, ends, before, first)],
        schema=result_schema,
    )


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Windows of 13 words over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_windows(docs).select("doc_id", "n_words", "n_removed", "n_spans", "kept_sha256")
