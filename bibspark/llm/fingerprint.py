"""Document fingerprints: an improbable-feature digest.

Features are windows of 64 bytes (of a shorter text: the whole). A window's entropy, in thousandths
of its 6 bits, is looked up in the histogram of entropies over the whole corpus: the fewer windows
have that entropy, the rarer the feature. In each stretch of 64 consecutive windows the rarest
(leftmost on ties) gets a point; windows with at least 16 points are selected, as they stay the
choice of their surroundings wherever the passage stands. Selected features go, in their order,
into a chain of Bloom filters of 2048 bits, 5 bits a feature, at most 160 features a filter.

Two digests are compared filter by filter: the overlap of bits above what chance gives, over the
most it could be; each filter of the digest with fewer takes its best match, and these average,
weighted by features.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm import common as c

FEATURE = 64
STRETCH = 64
POINTS = 16
FILTER_BITS = 2048
PER_FILTER = 160
HASHES = 5
LEVELS = 1001
#: Windows measured at a time.
CHUNK = 1 << 20


def _gain() -> np.ndarray:
    """What one more of a byte already seen k times adds to sum(n log2 n), in units of 2**-20."""
    n = np.arange(FEATURE + 1, dtype=np.float64)
    total = n * np.log2(np.maximum(n, 1))
    return np.rint(np.diff(total) * (1 << 20)).astype(np.int64)


GAIN = _gain()
WHOLE = int(GAIN.sum())  # sum(n log2 n) of a window of one byte only


def entropies(buf: np.ndarray) -> np.ndarray:
    """Entropy of each window, from 0 to 1000. The sum over byte counts slides: a byte that leaves
    gives back the gain of its copies behind it, one that enters adds that of those before it."""
    n = len(buf)
    if n < FEATURE:
        return np.zeros(0, np.int16)
    out = np.empty(n - FEATURE + 1, np.int16)
    for at in range(0, len(out), CHUNK):
        part = buf[at : min(n, at + CHUNK + FEATURE - 1)]
        m = len(part)
        after, before = np.zeros(m, np.uint8), np.zeros(m, np.uint8)
        for low in range(0, m, 1 << 15):  # pieces that stay in the processor's cache
            high = min(m, low + (1 << 15))
            for k in range(1, FEATURE):
                stop = min(high, m - k)
                if stop <= low:
                    break
                equal = (part[low:stop] == part[low + k : stop + k]).view(np.uint8)
                after[low:stop] += equal
                before[low + k : stop + k] += equal
        head = int(GAIN[before_in_head(part)].sum())
        steps = GAIN[before[FEATURE:]] - GAIN[after[: m - FEATURE]]
        total = np.concatenate([[head], head + np.cumsum(steps)])
        out[at : at + len(total)] = np.rint((WHOLE - total) * (1000.0 / WHOLE)).astype(np.int16)
    return out


def before_in_head(part: np.ndarray) -> np.ndarray:
    """For each byte of the first window, its copies before it."""
    head = part[:FEATURE]
    return np.tril(head[:, None] == head[None, :], -1).sum(axis=1)


def histogram(docs: DataFrame) -> np.ndarray:
    """Windows of each entropy in the corpus: LEVELS counts, whatever its size."""

    def run(batches):
        counts = np.zeros(LEVELS, np.int64)
        for _, offs, buf in c.text_chunks(batches, 1 << 20):
            e = entropies(buf)
            counts += np.bincount(e[inside(len(e), offs)], minlength=LEVELS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS)), pa.array(counts)], ["level", "n"])

    rows = docs.select(F.lit(0).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(LEVELS, np.int64)
    for r in rows:
        out[r["level"]] = r["n"]
    return out


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each entropy, rarest first."""
    out = np.empty(LEVELS, np.int64)
    out[np.argsort(counts, kind="stable")] = np.arange(LEVELS)
    return out


def inside(n: int, offs: np.ndarray) -> np.ndarray:
    """Which windows cross no bound of a document."""
    ok = np.ones(n, bool)
    for end in offs[1:-1].tolist():
        ok[max(0, end - FEATURE + 1) : end] = False
    return ok


class Digests:
    """Digests of several texts: filters (rows of packed bits), features in each, and for each text
    its first filter."""

    def __init__(self, offs: np.ndarray, buf: np.ndarray, rank: np.ndarray):
        place, doc = self.select(offs, buf, rank)
        n_docs = len(offs) - 1
        lens = np.diff(offs)
        short = np.flatnonzero((lens > 0) & (lens < FEATURE))
        base = c.BASES[1]
        h, inv = c.prefix_hash(buf, base), c.powers(c.inverse(base), len(buf) + 1)
        start = np.concatenate([place, offs[short]])
        end = np.concatenate([place + FEATURE, offs[short + 1]])
        owner = np.concatenate([doc, short])
        feature = c.mix((h[end] - h[start]) * inv[start] + (end - start).astype(c.U64))
        order = np.lexsort((start, feature, owner))  # a feature counts once in a document
        new = np.ones(len(order), bool)
        new[1:] = (feature[order][1:] != feature[order][:-1]) | (owner[order][1:] != owner[order][:-1])
        pick = np.sort(order[new])
        pick = pick[np.lexsort((start[pick], owner[pick]))]
        feature, owner = feature[pick], owner[pick]
        per_doc = np.bincount(owner, minlength=n_docs)
        filters = -(-per_doc // PER_FILTER)
        self.first = np.concatenate([[0], np.cumsum(filters)])
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        at = self.first[owner] + nth // PER_FILTER
        bits = np.zeros((int(self.first[-1]), FILTER_BITS), np.uint8)
        for k in range(HASHES):
            bits[at, ((feature >> c.U64(11 * k)) & c.U64(FILTER_BITS - 1)).astype(np.int64)] = 1
        self.bits = np.packbits(bits, axis=1)
        self.ones = bits.sum(axis=1, dtype=np.int64)
        self.features = np.bincount(at, minlength=int(self.first[-1]))

    @staticmethod
    def select(offs, buf, rank):
        """Windows with enough points, and their documents."""
        e = entropies(buf)
        n = len(e)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        ok = inside(n, offs)
        key = (np.where(ok, rank[e], LEVELS) << 32) | np.arange(n)
        low = key
        span = 1
        while 2 * span <= STRETCH and span < len(low):
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        won = low & 0xFFFFFFFF
        # only stretches within a document give points; one with fewer windows is one stretch
        last = np.arange(len(won)) + span - 1
        whole = ok[: len(won)] & ok[last]
        doc_of = np.searchsorted(offs, np.arange(len(won)), side="right") - 1
        whole &= last + FEATURE <= offs[doc_of + 1]
        points = np.bincount(won[whole], minlength=n)
        place = np.flatnonzero(points >= POINTS)
        lens = np.diff(offs)
        few = np.flatnonzero((lens >= FEATURE) & (lens < FEATURE + STRETCH - 1))
        extra = [offs[d] + int(np.argmin(rank[e[offs[d] : offs[d] + lens[d] - FEATURE + 1]])) for d in few]
        place = np.concatenate([place, np.array(extra, np.int64)])
        return place, np.searchsorted(offs, place, side="right") - 1

    def text(self, k: int) -> str:
        """The fingerprint as a string: features of each filter, then the filters."""
        part = slice(self.first[k], self.first[k + 1])
        return f"{'.'.join(map(str, self.features[part]))}:{base64.b64encode(self.bits[part].tobytes()).decode()}"

    def parts(self, k: int):
        part = slice(self.first[k], self.first[k + 1])
        return self.bits[part], self.ones[part], self.features[part]


def read_digest(s: str):
    """The filters, their bits set and features of a fingerprint string."""
    counts, _, body = s.partition(":")
    bits = np.frombuffer(base64.b64decode(body), np.uint8).reshape(-1, FILTER_BITS // 8)
    return bits, np.bitwise_count(bits).sum(axis=1, dtype=np.int64), np.array([int(x) for x in counts.split(".") if x], np.int64)


def likeness(a, b) -> float:
    """0 to 1: normalised bit overlap; two empty digests are alike, an empty one is like no other."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    if len(a[0]) > len(b[0]) or (len(a[0]) == len(b[0]) and a[2].sum() > b[2].sum()):
        a, b = b, a
    best = np.empty(len(a[0]))
    wide = b[0].view(c.U64)
    for k in range(len(a[0])):
        both = np.bitwise_count(a[0][k].view(c.U64)[None, :] & wide).sum(axis=1, dtype=np.int64)
        chance = a[1][k] * b[1] / FILTER_BITS
        most = np.minimum(a[1][k], b[1])
        best[k] = np.max(np.clip((both - chance) / np.maximum(most - chance, 1e-9), 0.0, 1.0))
    return round(float((best * a[2]).sum() / a[2].sum()), 6)


def digest(text: str | None, rank: np.ndarray) -> str:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return Digests(np.array([0, len(data)]), data, rank).text(0)


def edit(text: str, following: str) -> str:
    """The last third of the code points replaced by as many first ones (or all) of the next."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


# ---------------------------------------------------------------- operator
def fingerprints(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, more) -> doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next. The next document is that of the next smaller
    doc_id, after the smallest the largest; null ids are smallest; equal ids stand in an order that
    their texts fix.

    A null text is empty and has an empty digest; a single document follows itself; an empty table
    gives an empty result; more columns of docs are not used.

    Documents are cut by doc_id at quantiles, and the first of each part also goes, marked, to the
    part before it, so that each part finds all its successors.
    """
    spark = docs.sparkSession
    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rank = ranks(histogram(two))
    n_parts = 4 * c.partitions(spark)
    quantiles = [k / n_parts for k in range(1, n_parts)]
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    found = two.agg(F.percentile_approx(key, quantiles, 10 * n_parts).alias("q")).first()["q"] or []
    cuts = np.array(sorted(set(found)), np.int64)

    def part_of(ids):
        """Number of cuts below each id (null: the smallest)."""
        return np.searchsorted(cuts, ids.cast(pa.int64()).fill_null(-(1 << 63)).to_numpy(), side="left")

    def top_ids(batches):
        for batch in batches:
            parts = part_of(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), batch.column(0).cast(pa.int64()).fill_null(-(1 << 63))], ["part", "top"])

    tops = two.select("doc_id").mapInArrow(top_ids, "part int, top long").groupBy("part").agg(F.max("top").alias("top"))
    tops = {r["part"]: r["top"] for r in tops.collect()}  # a row for each part
    names = sorted(tops)
    turn = {p: names[k + 1] if k + 1 < len(names) else names[0] for k, p in enumerate(names)}  # the part before p, in descending order

    def pack(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64()).fill_null(-(1 << 63)).to_pylist()
            null = batch.column(0).is_null().to_pylist()
            parts, texts = part_of(batch.column(0)).tolist(), batch.column(1).to_pylist()
            out = []
            for i, z, p, t in zip(ids, null, parts, texts, strict=True):
                packed = c.zip_bytes(t, 3)
                out.append((p, i, z, False, packed))
                if i == tops[p]:
                    out.append((turn[p], i, z, True, packed))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()), strict=True)], ["part", "id", "null", "guest", "data"])

    def run(batches):
        """Rows come by part, guests last, larger ids first."""
        held, waiting = [], None
        for batch in batches:
            for row in batch.to_pylist():
                text = c.unzip_bytes(row["data"]).decode()
                if waiting is not None and waiting[0] == row["part"] and not waiting[5]:
                    held.append((waiting, text))
                    if sum(len(w[4]) for w, _ in held) > 1 << 20:
                        yield digests(held)
                        held = []
                if not row["guest"]:
                    waiting = (row["part"], row["id"], row["null"], False, text, False)
                else:
                    waiting = (row["part"], row["id"], row["null"], True, text, True)
        if held:
            yield digests(held)

    def digests(held):
        texts = [w[4].encode() for w, _ in held]
        edited = [edit(w[4], nxt).encode() for w, nxt in held]
        # in runs of one part each next is the following row: only the last of a run is digested anew
        follow = [k + 1 if k + 1 < len(held) and held[k][1] == held[k + 1][0][4] else None for k in range(len(held))]
        lone = [k for k, f in enumerate(follow) if f is None]
        every = texts + edited + [held[k][1].encode() for k in lone]
        offs = np.concatenate([[0], np.cumsum([len(t) for t in every])]).astype(np.int64)
        d = Digests(offs, np.frombuffer(b"".join(every), np.uint8), rank)
        n = len(held)
        spot = {k: 2 * n + j for j, k in enumerate(lone)}
        cols = [
            pa.array([None if w[2] else w[1] for w, _ in held], pa.int64()),
            pa.array([len(w[4]) for w, _ in held], pa.int64()),
            pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
            pa.array([d.text(k) for k in range(n)]),
            pa.array([d.text(n + k) for k in range(n)]),
            pa.array([likeness(d.parts(k), d.parts(n + k)) for k in range(n)], pa.float64()),
            pa.array([likeness(d.parts(k), d.parts(spot.get(k, follow[k]))) for k in range(n)], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    packed = two.withColumn("text", F.col("text").cast("binary")).mapInArrow(pack, "part int, id long, null boolean, guest boolean, data binary")
    # equal ids: by text; a guest follows the smallest of its part
    dealt = packed.repartition(c.partitions(spark), "part").sortWithinPartitions("part", "guest", F.desc("id"), F.xxhash64("data"), "data")
    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op7_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Digests of all documents and of their edited texts."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
