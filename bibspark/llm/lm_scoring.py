"""LM scoring: an interpolated modified Kneser-Ney bigram model over all training texts.

Counting is a shuffle of packed, block-wise distinct bigrams; the counts of one bucket become one
sorted hash array, and the words' context totals, continuation counts and unigram counts another.
The arrays are files in the shared folder that spark.checkpoint.dir names. Workers map them into
memory and look up the distinct bigrams of a block in sorted order; scoring needs no exchange.

    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v.) + (D1 n1(v) + D2 n2(v) + D3 n3(v)) / c(v.) * p(w)
    p(w)     = max(k(w) - D(k(w)), 0) / K + (D1 N1 + D2 N2 + D3 N3) / K / (V + 1)

k(w): distinct words before w; K: their sum; D1, D2, D3: discounts by the counts of counts. One
share of the uniform part is for words never seen.

Words are 64-bit hashes in the unigram array and 40-bit ones in the model; a bigram is told from
others of its shard by 48 bits.
"""

from __future__ import annotations

import os
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm import common as c
from bibspark.llm.substring_dedup import bucket_bounds
from bibspark.llm.suffix_dedup import join_parts, split_parts

FOLDS, HELD = 7, 2
END = c.U64(0x1D8E4E27C47D124F)
BEGIN = c.U64(0xEB44ACCAB455D165)
WIDE = c.U64(24)  # 64-bit word hash -> 40 bits
#: Leading bits of the second word that help to choose a bigram's bucket: a frequent first word's
#: bigrams are spread over 16 of them.
SPREAD = c.U64(36)
RESULT = "doc_id long, n_tokens long, n_known long, base_score double, score double"


# ---------------------------------------------------------------- tokens
def tokens(buf: np.ndarray, offs: np.ndarray):
    """Word hashes with an end for each document; those before them; each document's first token."""
    low = c.LOWER[buf]
    starts, ends, first = c.word_spans(low, offs)
    n_docs = len(offs) - 1
    at = first + np.arange(n_docs + 1)
    t = np.empty(at[-1], c.U64)
    ending = at[1:] - 1
    inner = np.ones(len(t), bool)
    inner[ending] = False
    t[ending] = END
    t[inner] = c.word_hashes(low, starts, ends)
    prev = np.empty_like(t)
    prev[1:] = t[:-1]
    prev[at[:-1]] = BEGIN
    return t, prev, at


def bigram_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return c.mix(v * c.U64(c.BASES[0]) + c.mix(w))


def bigram_bucket(v: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    return c.mix(v * c.U64(c.BASES[3]) + (w >> SPREAD)) >> c.U64(64 - bits)


def count_distinct(keys: np.ndarray):
    """Sorted distinct keys, one index of each, counts."""
    order = np.argsort(keys)
    s = keys[order]
    at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[at], order[at], np.diff(np.append(at, len(s)))


# ---------------------------------------------------------------- files of sorted arrays
def local_path(folder: str) -> str:
    """The mounted path of the shared folder; a store without one cannot be memory-mapped."""
    url = urlparse(folder)
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped models need spark.checkpoint.dir on a mounted file system, not {folder}")
    return unquote(url.path)


def write_arrays(path: str, *arrays: np.ndarray) -> None:
    """One file: number of arrays, then for each its type size and length, then their bytes. The
    file appears whole, so that a repeated task does no harm."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temporary = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    head = np.array([len(arrays), *[x for a in arrays for x in (a.dtype.itemsize, len(a))]], np.int64)
    with open(temporary, "wb") as f:
        f.write(head.tobytes())
        for a in arrays:
            f.write(a.tobytes())
            f.write(b"\0" * (-a.nbytes % 8))
    os.replace(temporary, path)


@lru_cache(maxsize=4096)
def map_arrays(path: str) -> list[np.ndarray]:
    """Every shard has a file, if only an empty one: where it is missing, the folder is not shared or
    has been emptied, and the error says so."""
    raw = np.memmap(path, np.uint8, "r")
    n = int(raw[:8].view(np.int64)[0])
    sizes = raw[8 : 8 + 16 * n].view(np.int64).tolist()
    at, out = 8 + 16 * n, []
    for width, length in zip(sizes[::2], sizes[1::2], strict=True):
        out.append(raw[at : at + width * length].view(f"u{width}"))
        at += width * length + -(width * length) % 8
    return out


def find(sorted_keys: np.ndarray, keys: np.ndarray):
    """Place of each key in an array, and whether it is there."""
    at = np.searchsorted(sorted_keys, keys)
    inside = np.minimum(at, len(sorted_keys) - 1) if len(sorted_keys) else at
    return inside, (sorted_keys[inside] == keys if len(sorted_keys) else np.zeros(len(keys), bool))


# ---------------------------------------------------------------- counting
def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts within one block of text."""
    return counts.astype(np.uint32)


def train(docs: DataFrame) -> dict:
    """docs (text) of the training fold -> the model: folder, bits of its shards, N, V, discounts."""
    spark = docs.sparkSession
    folder = local_path(c.shared_dir(spark))
    n_bytes = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    bits = c.buckets(spark, n_bytes, 1).bit_length() - 1  # every bucket of bigrams sends to every bucket of words

    def send(batches):
        for _, offs, buf in c.text_chunks(batches):
            t, prev, _ = tokens(buf, offs)
            words, _, n = count_distinct(t)
            rows = []
            at = bucket_bounds(words, bits)
            for b in np.flatnonzero(np.diff(at)).tolist():
                part = slice(at[b], at[b + 1])
                rows.append((b, 0, join_parts([c.enc(words[part], delta=True), c.enc(narrow(n[part]))])))
            v, w = prev >> WIDE, t >> WIDE
            _, pick, n = count_distinct(bigram_keys(v, w))
            v, w = v[pick], w[pick]
            bucket = bigram_bucket(v, w, bits)
            order = np.lexsort((w, (bucket << c.U64(40)) | v))
            v, w, n, bucket = v[order], w[order], n[order], bucket[order]
            at = np.searchsorted(bucket, np.arange((1 << bits) + 1, dtype=c.U64))
            for b in np.flatnonzero(np.diff(at)).tolist():
                part = slice(at[b], at[b + 1])
                head = np.flatnonzero(np.concatenate([[True], v[part][1:] != v[part][:-1]]))
                run = np.diff(np.append(head, at[b + 1] - at[b]))
                rows.append((b, 1, join_parts([c.enc(v[part][head], delta=True), c.enc(narrow(run)), c.enc(w[part]), c.enc(narrow(n[part]))])))
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int8(), pa.binary()), strict=True)], ["bucket", "kind", "payload"])

    def count_bigrams(table):
        """Writes one shard of bigrams; sends on what their words need to know."""
        parts = [(k, split_parts(p)) for k, p in zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True) if k < 4]
        bucket = table.column("bucket")[0].as_py()
        rows = [(bucket, 0, join_parts(p)) for k, p in parts if k == 0]
        parts = [p for k, p in parts if k == 1]
        of_counts = np.zeros(5, np.int64)
        if not parts:
            none = np.zeros(0, np.int64)
            write_arrays(f"{folder}/bigrams/{bucket:08x}", none.astype(np.uint32), none.astype(np.uint16), none.astype(np.uint8), none, none)
        if parts:
            v = np.concatenate([np.repeat(c.dec(p[0], c.U64, delta=True), c.dec(p[1], np.uint32)) for p in parts])
            w = np.concatenate([c.dec(p[2], c.U64) for p in parts])
            n = np.concatenate([c.dec(p[3], np.uint32) for p in parts]).astype(np.int64)
            order = np.argsort(keys := bigram_keys(v, w))
            s = keys[order]
            at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            n = np.add.reduceat(n[order], at)
            v, w, s = v[order[at]], w[order[at]], s[at]
            write_arrays(f"{folder}/bigrams/{bucket:08x}", (s >> c.U64(32)).astype(np.uint32), ((s >> c.U64(16)) & c.U64(0xFFFF)).astype(np.uint16), np.minimum(n, 255).astype(np.uint8), np.flatnonzero(n >= 255).astype(np.int64), n[n >= 255])
            of_counts = np.bincount(np.minimum(n, 5), minlength=6)[1:]
            by = np.argsort(v, kind="stable")
            at = np.flatnonzero(np.concatenate([[True], v[by][1:] != v[by][:-1]]))
            stats = [np.add.reduceat(x[by], at) for x in (n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n >= 3).astype(np.int64))]
            rows += spread(v[by][at], stats, 1)
            after, _, before = count_distinct(w)
            rows += spread(after, [before], 2)
        rows.append((bucket, 3, of_counts.astype(np.int64).tobytes()))
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int8(), pa.binary()), strict=True)], ["bucket", "kind", "payload"])

    def spread(words, stats, kind):
        at = bucket_bounds(words << WIDE, bits)
        return [(b, kind, join_parts([c.enc(words[at[b] : at[b + 1]], delta=True), *[c.enc(s[at[b] : at[b + 1]].astype(np.int64)) for s in stats]])) for b in np.flatnonzero(np.diff(at)).tolist()]

    def merge(parts, n_stats, kind=np.int64):
        """Distinct words of packed lists and the sums of their figures."""
        if not parts:
            return np.zeros(0, c.U64), [np.zeros(0, np.int64)] * n_stats
        words = np.concatenate([c.dec(p[0], c.U64, delta=True) for p in parts])
        order = np.argsort(words)
        s = words[order]
        at = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        return s[at], [np.add.reduceat(np.concatenate([c.dec(p[1 + k], kind) for p in parts]).astype(np.int64)[order], at) for k in range(n_stats)]

    def count_words(table):
        kinds, payloads = table.column("kind").to_pylist(), table.column("payload").to_pylist()
        bucket = table.column("bucket")[0].as_py()
        lists = {k: [split_parts(p) for j, p in zip(kinds, payloads, strict=True) if j == k] for k in (0, 1, 2)}
        words, (n,) = merge(lists[0], 1, np.uint32)
        contexts, stats = merge(lists[1], 4)
        after, (before,) = merge(lists[2], 1)
        write_arrays(f"{folder}/words/{bucket:08x}", words, n, contexts, *stats, after, before)
        of_counts = sum((np.frombuffer(p, np.int64) for j, p in zip(kinds, payloads, strict=True) if j == 3), np.zeros(5, np.int64))
        of_before = np.bincount(np.minimum(before, 5), minlength=6)[1:]
        figures = [int(n.sum()), len(words), int(before.sum()), *of_counts.tolist(), *of_before.tolist()]
        return pa.table({"figures": pa.array([figures], pa.list_(pa.int64()))})

    sent = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(send, "bucket int, kind byte, payload binary")
    every = spark.range(1 << bits).select(F.col("id").cast("int").alias("bucket"), F.lit(4).cast("byte").alias("kind"), F.lit(b"").alias("payload"))  # so that each has its files
    first = sent.unionByName(every).groupBy("bucket").applyInArrow(count_bigrams, "bucket int, kind byte, payload binary")
    figures = first.groupBy("bucket").applyInArrow(count_words, "figures array<long>")
    total = figures.agg(*[F.coalesce(F.sum(F.col("figures")[k]), F.lit(0)).alias(f"f{k}") for k in range(13)]).first()
    return {"folder": folder, "bits": bits, "N": total[0], "V": total[1], "K": total[2], "D2": discounts(total[3:8]), "D1": discounts(total[8:13]), "of_before": list(total[8:13])}


def discounts(n) -> list[float]:
    """D1, D2, D3+ of Chen and Goodman; 0.5, 1 and 1.5 where counts of counts are missing."""
    n1, n2, n3, n4 = (float(x) for x in n[:4])
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.01), k - 0.01) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


# ---------------------------------------------------------------- scoring
def look_up(model: dict, buf: np.ndarray, offs: np.ndarray):
    """n_tokens, n_known, base score and score of each document."""
    t, prev, at = tokens(buf, offs)
    bits, folder = model["bits"], model["folder"]
    words, place = np.unique(t, return_inverse=True)
    count, before = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    seen, context = np.unique(prev >> WIDE, return_inverse=True)
    stats = np.zeros((4, len(seen)), np.int64)
    word_at, seen_at = bucket_bounds(words, bits), bucket_bounds(seen << WIDE, bits)
    for b in np.flatnonzero(np.diff(word_at) + np.diff(seen_at)).tolist():
        arrays = map_arrays(f"{folder}/words/{b:08x}")
        part = slice(word_at[b], word_at[b + 1])
        k, ok = find(arrays[0], words[part])
        count[part][ok] = arrays[1][k[ok]]
        k, ok = find(arrays[7], words[part] >> WIDE)
        before[part][ok] = arrays[8][k[ok]]
        part = slice(seen_at[b], seen_at[b + 1])
        k, ok = find(arrays[2], seen[part])
        for j in range(4):
            stats[j][part][ok] = arrays[3 + j][k[ok]]
    v, w = prev >> WIDE, t >> WIDE
    keys, pick, _ = count_distinct(bigram_keys(v, w))
    shard = bigram_bucket(v[pick], w[pick], bits)
    order = np.argsort(shard, kind="stable")  # keys stay sorted within a shard
    shard_at = np.searchsorted(shard[order], np.arange((1 << bits) + 1, dtype=c.U64))
    pair = np.zeros(len(keys), np.int64)
    for b in np.flatnonzero(np.diff(shard_at)).tolist():
        arrays = map_arrays(f"{folder}/bigrams/{b:08x}")
        if not len(arrays[0]):
            continue
        mine = order[shard_at[b] : shard_at[b + 1]]
        high, low, small, large_at, large = arrays
        q, r = (keys[mine] >> c.U64(32)).astype(np.uint32), ((keys[mine] >> c.U64(16)) & c.U64(0xFFFF)).astype(np.uint16)
        k, ok = find(high, q)
        while len(miss := np.flatnonzero(ok & (low[k] != r))):  # equal leading bits: the next one
            k[miss] += 1
            beyond = k[miss] >= len(high)
            k[miss[beyond]] -= 1
            ok[miss] = ~beyond & (high[k[miss]] == q[miss])
        n = small[k].astype(np.int64)
        big = np.flatnonzero(n == 255)
        n[big] = large[np.searchsorted(large_at, k[big])]
        pair[mine[ok]] = n[ok]
    pair = pair[np.searchsorted(keys, bigram_keys(v, w))]
    d1, d2 = np.array([0.0, *model["D1"]]), np.array([0.0, *model["D2"]])
    mass = max(model["K"], 1)
    ones = model["of_before"]
    rest = (d1[1] * ones[0] + d1[2] * ones[1] + d1[3] * sum(ones[2:])) / mass if model["K"] else 1.0
    p1 = np.maximum(before - d1[np.minimum(before, 3)], 0) / mass + rest / (model["V"] + 1)
    total = stats[0][context]
    left = (stats[1:].T @ d2[1:])[context]
    safe = np.maximum(total, 1)
    p2 = np.maximum(pair - d2[np.minimum(pair, 3)], 0) / safe + np.where(total > 0, left / safe, 1.0) * p1[place]
    base = np.log10((count + 1) / (model["N"] + 1 * (model["V"] + 1)))[place]
    known = (count > 0)[place]
    sums = [np.add.reduceat(x, at[:-1]) for x in (known.astype(np.int64), base, np.log10(p2))] if len(t) else [at[:-1]] * 3
    return np.diff(at), *sums


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_tokens, n_known, base_score, score."""

    def run(batches):
        for ids, offs, buf in c.text_chunks(batches):
            n, known, base, value = look_up(model, buf, offs)
            yield pa.RecordBatch.from_arrays([c.id_array(ids), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(value, pa.float64())], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, RESULT)


def score_documents(docs: DataFrame, folds: int = FOLDS, held: int = HELD) -> DataFrame:
    """docs (doc_id, text, more) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score; perplexity follows as 10 ** (-score / n_tokens).

    Learns from the rows whose crc32(doc_id) mod folds is not `held`; a null doc_id is not held
    out. A null or empty text is one end token. Repeated rows count each time. Without training
    rows every token has the uniform share. More columns of docs are not used.
    """
    fold = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(folds)) == held, F.lit(False))
    model = train(docs.where(~fold))
    return score(docs, model).select("doc_id", fold.alias("held_out"), "n_tokens", "n_known", F.lit(model["N"]).cast("long").alias("train_tokens"), "base_score", "score")


def op4_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents under the model of six folds of seven."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
