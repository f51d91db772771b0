"""Suffix-array dedup: repeated byte strings found by a hash-compared suffix sort.

A string of `length` bytes is repeated if it also starts in a document with a smaller doc_id. All
suffixes of a corpus cannot meet in one array, so they are dealt out first and sorted where equal
ones meet:

1. Every `length`-byte window names an anchor inside it: the gram (half its length) with the least
   polynomial hash, leftmost on ties. The choice depends on the window's bytes alone, so equal
   windows have equal anchors; consecutive windows mostly share theirs. Blocks of documents send
   32 bits of each distinct anchor, packed, to the bucket of its leading bits, which answers with
   two bits each: is it in another block as well, and in HOT_BLOCKS or more? Windows that are in no
   other block are in no other document.
2. Consecutive windows of a shared anchor form one segment of text. Blocks send each distinct
   segment once, with the smallest doc_id that holds it (its other holders' bytes are settled in
   the block itself, after a comparison of the bytes), to the anchor's bucket. Segments of a hot
   anchor, such as a common phrase in many surroundings, are cut where a second anchor, least by
   another hash, changes, and go by both, so that they do not meet in one group.
3. A bucket leaves out segments whose bytes a segment of a smaller doc_id has (compared) and sorts
   the suffixes that start at the others' windows, group by group of equal anchor and offset, in a bottom-up mergesort over all groups at once. Two suffixes are compared through
   prefix polynomial hashes: equal over the whole length, or else the common extension is found
   by binary search, in a logarithmic number of hash comparisons, and the next byte decides.
   Neighbours that the hashes call equal are compared byte by byte; at a collision the bucket
   starts anew with another base, and lastly sorts the bytes themselves. Within a run of equal
   suffixes all but those of the smallest doc_id are repeated.
4. Blocks get back the repeated byte intervals, merge them and hash what is left.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from bibspark.llm import common as c
from bibspark.llm.substring_dedup import bucket_bounds, distinct, runs, span_lists

LENGTH = 50
#: Bytes of text in one block, and of segments that are sorted at a time.
BLOCK_BYTES, SORT_BYTES = 2 << 20, 1 << 20
#: Blocks that hold an anchor from which on it is hot.
HOT_BLOCKS = 64
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:int,end:int>>"
result_schema = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("n_removed", pa.int64()),
        ("n_spans", pa.int64()),
        ("kept_sha256", pa.string()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    ]
)


# ---------------------------------------------------------------- anchors and segments
def segments(buf: np.ndarray, offs: np.ndarray, length: int, base: int = c.BASES[0]):
    """Runs of consecutive windows with one anchor: start, number of windows, anchor's offset from
    the start, anchor's hash."""
    n = len(buf)
    gram = length // 2
    width = length - gram + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, c.U64)
    h = c.prefix_hash(buf, base)
    g = c.mix((h[gram:] - h[:-gram]) * c.powers(c.inverse(base), n - gram + 1))
    bits = int(n).bit_length()
    low = (g >> c.U64(bits) << c.U64(bits)) | np.arange(len(g), dtype=c.U64)
    span = 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < width:
        low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
    anchor = (low & c.U64((1 << bits) - 1)).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    for end in offs[1:-1].tolist():
        valid[max(0, end - length + 1) : end] = False
    first = valid.copy()
    first[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
    stop = np.flatnonzero(first | ~valid)
    start = np.flatnonzero(first)
    after = np.append(stop, len(anchor))[np.searchsorted(stop, start, side="right")]
    at = anchor[start]
    return start, after - start, at - start, g[at]


def cut_hot(buf: np.ndarray, offs: np.ndarray, length: int, start, count, rel, key):
    """Cuts segments where the second anchor changes: the number of the segment that each part comes
    from, and the parts' start, count, rel and key of both anchors."""
    second, _, _, other = segments(buf, offs, length, c.BASES[3])
    low, high = np.searchsorted(second, start, side="right"), np.searchsorted(second, start + count)
    parts = high - low + 1
    of = np.repeat(np.arange(len(start)), parts)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
    at = low[of] + nth
    begin = np.where(nth == 0, start[of], second[np.maximum(at - 1, 0)])
    end = np.where(nth == parts[of] - 1, (start + count)[of], second[np.minimum(at, len(second) - 1)])
    run = np.searchsorted(second, begin, side="right") - 1
    return of, begin, end - begin, rel[of] - (begin - start[of]), c.mix(key[of] + other[run])


def loads(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position, as one number (the last positions read zeros)."""
    pad = np.concatenate([buf, np.zeros(8, np.uint8)])
    return np.lib.stride_tricks.as_strided(pad[:8].view(c.U64), (len(buf), ), (1,), writeable=False)


def same_bytes(words: np.ndarray, a: np.ndarray, b: np.ndarray, lens) -> np.ndarray:
    """Are the lens (>= 8) bytes from a and from b equal?"""
    lens = np.broadcast_to(lens, a.shape)
    ok = np.ones(len(a), bool)
    for off in range(0, int(lens.max(initial=0)), 8):
        at = np.minimum(off, lens - 8)
        ok &= words[a + at] == words[b + at]
    return ok


def gather(buf: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    ends = np.cumsum(lens)
    return buf[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lens), lens)]


def cover(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge)[:-1] > 0


def is_in(a: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    """Membership of a's numbers in a sorted array, at the cost of a's length."""
    if not len(sorted_):
        return np.zeros(len(a), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, a), len(sorted_) - 1)] == a


def copies(buf: np.ndarray, start: np.ndarray, size: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Segments (start, size, owner) whose bytes are those of a segment of the smallest owner, other
    than their own: found by polynomial hashes, then compared."""
    h = c.prefix_hash(buf, c.BASES[1])
    content = c.mix((h[start + size] - h[start]) * c.powers(c.inverse(c.BASES[1]), len(buf) + 1)[start] + size.astype(c.U64))
    by = np.lexsort((owner, content))
    s = content[by]
    new = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
    rep = np.empty(len(by), np.int64)
    rep[by] = by[np.flatnonzero(new)][np.cumsum(new) - 1] if len(by) else by
    later = np.flatnonzero(owner > owner[rep])
    later = later[size[later] == size[rep[later]]]
    return later[same_bytes(loads(buf), start[later], start[rep[later]], size[later])]


# ---------------------------------------------------------------- suffix sort
class Suffixes:
    """Suffixes of buf, compared over at most `length` bytes by prefix polynomial hashes."""

    def __init__(self, buf: np.ndarray, length: int, base: int):
        self.buf, self.length = buf, length
        self.h = c.prefix_hash(buf, base)
        self.inv = c.powers(c.inverse(base), len(buf) + 1)
        self.whole = (self.h[length:] - self.h[:-length]) * self.inv[: len(buf) - length + 1]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common bytes of suffixes known to differ within `length`."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), self.length - 1)
        while (low < high).any():
            mid = (low + high + 1) >> 1
            equal = (self.h[a + mid] - self.h[a]) * self.inv[a] == (self.h[b + mid] - self.h[b]) * self.inv[b]
            low, high = np.where(equal, mid, low), np.where(equal, high, mid - 1)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """a before b, for suffixes that differ within `length`."""
        k = self.extension(a, b)
        return self.buf[a + k] < self.buf[b + k]


def merge_sort(suffixes: Suffixes, pos: np.ndarray, ids: np.ndarray, group_start: np.ndarray, group_size: np.ndarray) -> np.ndarray:
    """Order of pos within each group (groups are slices), equal suffixes by id: bottom-up
    mergesort. Two runs that are in order as they stand are left alone; in others an element's
    place is its rank in the sibling run, found by binary search for all elements at once."""
    order = np.arange(len(pos))
    start, size = np.repeat(group_start, group_size), np.repeat(group_size, group_size)
    whole = suffixes.whole[pos]

    def less(e, f, or_equal):
        """Element e before f; on equal suffixes and ids as or_equal says."""
        out = (ids[e] < ids[f]) | (or_equal & (ids[e] == ids[f]))
        other = np.flatnonzero(whole[e] != whole[f])
        out[other] = suffixes.before(pos[e[other]], pos[f[other]])
        return out

    width = 1
    while width < group_size.max(initial=0):
        at = np.flatnonzero(size > width)
        local = at - start[at]
        run = local // width
        left = start[at] + (run & ~1) * width
        middle = left + width
        end = np.minimum(left + 2 * width, start[at] + size[at])
        heads = np.flatnonzero((at == left) & (middle < end))
        tangled = np.zeros(len(at), bool)
        tangled[heads] = less(order[middle[heads]], order[middle[heads] - 1], np.zeros(len(heads), bool))
        pair = np.cumsum(at == left) - 1
        tangled = tangled[np.flatnonzero(at == left)][pair]
        at, run, left, middle, end = at[tangled], run[tangled], left[tangled], middle[tangled], end[tangled]
        right = (run & 1).astype(bool)
        low, high = np.where(right, left, middle), np.where(right, middle, end)
        sibling = low.copy()
        mine = order[at]
        while len(open_ := np.flatnonzero(low < high)):
            mid = (low[open_] + high[open_]) >> 1
            before = less(order[mid], mine[open_], right[open_])
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]
        fresh = order.copy()
        fresh[at - np.where(right, width, 0) + (low - sibling)] = mine
        order = fresh
        width *= 2
    return order


def repeated(buf: np.ndarray, pos: np.ndarray, group: np.ndarray, ids: np.ndarray, length: int) -> np.ndarray:
    """For each suffix: do its first `length` bytes also start a suffix of a smaller id? group:
    equal for equal suffixes."""
    out = np.zeros(len(pos), bool)
    by = np.lexsort((ids, group))
    g = group[by]
    begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else np.zeros(0, np.int64)
    size = np.diff(np.append(begin, len(g)))
    if not len(g):
        return out
    mixed = np.minimum.reduceat(ids[by], begin) < np.maximum.reduceat(ids[by], begin)
    by = by[np.repeat(mixed, size)]
    size = size[mixed]
    begin = np.cumsum(size) - size
    p, i = pos[by], ids[by]
    words = loads(buf)
    heads = np.zeros(len(p), bool)
    heads[begin] = True
    for base in c.BASES:
        suffixes = Suffixes(buf, length, base)
        order = merge_sort(suffixes, p, i, begin, size)
        a, b = p[order[:-1]], p[order[1:]]
        equal = (suffixes.whole[a] == suffixes.whole[b]) & ~heads[1:]
        where = np.flatnonzero(equal)
        if same_bytes(words, a[where], b[where], length).all():
            break
    else:
        view = np.lib.stride_tricks.sliding_window_view(buf, length)[p]
        number = np.unique(view, axis=0, return_inverse=True)[1].reshape(-1)
        order = np.lexsort((i, number))
        equal = number[order][1:] == number[order][:-1]
    first = np.concatenate([[True], ~equal]) if len(p) else heads
    least = i[order][first][np.cumsum(first) - 1] if len(p) else i
    out[by[order]] = i[order] > least
    return out


def sort_segments(buf: np.ndarray, count: np.ndarray, rel: np.ndarray, owner: np.ndarray, length: int, settle_copies: bool = True):
    """Sorts the windows of segments that stand one after the other; gives the repeated intervals:
    segment, first byte and end, counted from the segment's start. A copy of a segment of a smaller
    owner is repeated as a whole; only the others' windows are sorted (all, if not settle_copies)."""
    size = count + length - 1
    first = np.cumsum(size) - size
    whole = copies(buf, first, size, owner) if settle_copies else np.zeros(0, np.int64)
    alone = np.ones(len(count), bool)
    alone[whole] = False
    alone = np.flatnonzero(alone)
    n = count[alone]
    seg = np.repeat(alone, n)
    step = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    base, gram = c.BASES[2], length // 2
    h = c.prefix_hash(buf, base)
    a = first + rel
    anchor = c.mix((h[a + gram] - h[a]) * c.powers(c.inverse(base), len(buf) + 1)[a])
    del h
    group = c.mix(anchor[seg] + (rel[seg] - step).astype(c.U64))
    hit = repeated(buf, first[seg] + step, group, owner[seg], length)
    edge, close = hit.copy(), hit.copy()
    edge[1:] &= ~hit[:-1] | (seg[1:] != seg[:-1])
    close[:-1] &= ~hit[1:] | (seg[1:] != seg[:-1])
    x, y = np.flatnonzero(edge), np.flatnonzero(close)
    return np.concatenate([whole, seg[x]]), np.concatenate([np.zeros_like(whole), step[x]]), np.concatenate([size[whole], step[y] + length])


# ---------------------------------------------------------------- operator
def dedup_strings(docs: DataFrame, length: int = LENGTH, settle_copies: bool = True, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """docs (doc_id, text, more) -> doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the
    removed byte spans [start, end). settle_copies: whole copies of a segment, bytes compared, need
    no sort; without it the suffix sort alone decides, with the same result at a higher cost.

    A null text is empty; a null doc_id counts as larger than all others; rows that share a doc_id
    do not remove each other's bytes; texts under `length` bytes stay whole; more columns of docs
    are not used. An empty table gives an empty result.
    """
    if length < 16:
        raise ValueError("length must be at least 16")
    blocks = c.pack_blocks(docs, BLOCK_BYTES)
    bits = c.buckets(docs.sparkSession, c.total_bytes(blocks)).bit_length() - 1
    shift = c.U64(32 - bits)

    def short(keys):
        return ((keys >> shift) & c.U64(0xFFFFFFFF)).astype(np.uint32)

    def send_anchors(batches):
        for batch in batches:
            for row in batch.to_pylist():
                _, offs, buf = c.open_block(row)
                keys = np.unique(segments(buf, offs, length)[3])
                c.trim()
                at = bucket_bounds(keys, bits)
                full = np.flatnonzero(np.diff(at)).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(full, pa.int32()),
                        pa.array([row["block"]] * len(full), pa.int64()),
                        pa.array([c.enc(short(keys[at[b] : at[b + 1]]), delta=True) for b in full], pa.binary()),
                    ],
                    ["bucket", "block", "anchors"],
                )

    def judge_anchors(table):
        rows = table.to_pylist()
        parts = [c.dec(r["anchors"], np.uint32, delta=True) for r in rows]
        every = np.concatenate([np.unique(p) for p in parts])
        every, blocks_of = np.unique(every, return_counts=True)
        twice, hot = every[blocks_of > 1], every[blocks_of >= hot_blocks]
        bits_of = [c.zip_bytes(np.packbits(np.concatenate([is_in(p, twice), is_in(p, hot)])).tobytes(), 1) for p in parts]
        return pa.table(
            {
                "block": pa.array([r["block"] for r in rows], pa.int64()),
                "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
                "n": pa.array([len(p) for p in parts], pa.int64()),
                "bits": pa.array(bits_of, pa.binary()),
            }
        )

    def send_segments(block, answers):
        out = []
        told = [np.unpackbits(np.frombuffer(c.unzip_bytes(a["bits"]), np.uint8), count=2 * a["n"]).reshape(2, -1) for a in sorted(answers.to_pylist(), key=lambda a: a["bucket"])]
        shared, hot = np.concatenate(told, axis=1).astype(bool) if told else np.zeros((2, 0), bool)
        for row in block.to_pylist():
            ids, offs, buf = c.open_block(row)
            start, count, rel, key = segments(buf, offs, length)
            if not len(start):
                continue
            owner = ids[np.searchsorted(offs, start, side="right") - 1]
            keys, low, place = distinct(key, owner)
            high = np.full(len(keys), -1)
            np.maximum.at(high, place, owner)
            pick = np.flatnonzero((shared | (low < high))[place])
            start, count, rel, key, owner = start[pick], count[pick], rel[pick], key[pick], owner[pick]
            if (crowded := hot[place[pick]]).any():
                of, *parts = cut_hot(buf, offs, length, *(x[crowded] for x in (start, count, rel, key)))
                start, count, rel, key = (np.concatenate([x[~crowded], part]) for x, part in zip((start, count, rel, key), parts, strict=True))
                owner = np.concatenate([owner[~crowded], owner[crowded][of]])
            size = count + length - 1
            later = copies(buf, start, size, owner) if settle_copies else np.zeros(0, np.int64)
            gone = cover(len(buf), start[later], start[later] + size[later])
            a, b, _ = runs(gone, offs)
            out.append((int(row["block"]) & ((1 << bits) - 1), row["block"], 1, pack_spans(a, b)))
            keep = np.ones(len(start), bool)
            keep[later] = False
            keep = np.flatnonzero(keep)
            keep = keep[np.argsort(key[keep] >> c.U64(64 - bits), kind="stable")]
            at = bucket_bounds((key[keep] >> c.U64(64 - bits)) << c.U64(64 - bits), bits)
            for k in np.flatnonzero(np.diff(at)).tolist():
                w = keep[at[k] : at[k + 1]]
                parts = [c.enc(((key[w] >> c.U64(56 - bits)) & c.U64(255)).astype(np.uint8)), c.enc(owner[w]), c.enc(start[w].astype(np.uint32)), c.enc(count[w].astype(np.uint16)), c.enc(rel[w].astype(np.uint16)), c.zip_bytes(gather(buf, start[w], size[w]).tobytes(), 3)]
                out.append((k, row["block"], 0, join_parts(parts)))
        c.trim()
        return pa.Table.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), sent_types, strict=True)] if out else [pa.array([], t) for t in sent_types], ["bucket", "block", "kind", "payload"])

    sent_types = (pa.int32(), pa.int64(), pa.int8(), pa.binary())

    def sort_bucket(table):
        rows = table.to_pylist()
        out = [(r["block"], r["payload"]) for r in rows if r["kind"]]
        rows = [r for r in rows if not r["kind"]]
        if rows:
            parts = [split_parts(r["payload"]) for r in rows]
            sub = np.concatenate([c.dec(p[0], np.uint8) for p in parts]).astype(np.int64)
            owner = np.concatenate([c.dec(p[1], np.int64) for p in parts])
            start = np.concatenate([c.dec(p[2], np.uint32) for p in parts]).astype(np.int64)
            counts = [c.dec(p[3], np.uint16) for p in parts]
            of = np.repeat(np.arange(len(rows)), [len(x) for x in counts])
            count = np.concatenate(counts).astype(np.int64)
            rel = np.concatenate([c.dec(p[4], np.uint16) for p in parts]).astype(np.int64)
            buf = np.frombuffer(b"".join(c.unzip_bytes(p[5]) for p in parts), np.uint8)
            size = count + length - 1
            first = np.cumsum(size) - size
            pieces = len(buf) // SORT_BYTES + 1  # by anchor, so that no group is cut
            found = []
            for piece in range(pieces):
                mine = np.flatnonzero(sub * pieces >> 8 == piece)
                text = gather(buf, first[mine], size[mine])
                seg, begin, end = sort_segments(text, count[mine], rel[mine], owner[mine], length, settle_copies)
                found.append((of[mine][seg], start[mine][seg] + begin, start[mine][seg] + end))
            of, begin, end = (np.concatenate(x) for x in zip(*found, strict=True))
            by = np.argsort(of, kind="stable")
            of, begin, end = of[by], begin[by], end[by]
            cut = np.searchsorted(of, np.arange(len(rows) + 1))
            del buf, text
            c.trim()
            out += [(r["block"], pack_spans(begin[cut[k] : cut[k + 1]], end[cut[k] : cut[k + 1]])) for k, r in enumerate(rows) if cut[k + 1] > cut[k]]
        return pa.table({"block": pa.array([x[0] for x in out], pa.int64()), "spans": pa.array([x[1] for x in out], pa.binary())})

    def finish(block, answers):
        tables = [result_schema.empty_table()]
        spans = [unpack_spans(x) for x in answers.column(1).to_pylist()]
        for row in block.to_pylist():
            ids, offs, buf = c.open_block(row)
            gone = cover(len(buf), np.concatenate([s[0] for s in spans] or [offs[:0]]), np.concatenate([s[1] for s in spans] or [offs[:0]]))
            keep = buf[~gone].tobytes()
            total = np.concatenate([[0], np.cumsum(gone)])[offs]
            left = offs - total
            digests = [hashlib.sha256(keep[left[k] : left[k + 1]]).hexdigest() for k in range(len(ids))]
            a, b, before = runs(gone, offs)
            tables.append(
                pa.table(
                    [c.id_array(ids), pa.array(np.diff(offs), pa.int64()), pa.array(np.diff(total), pa.int64()), pa.array(np.diff(before), pa.int64()), c.hex_array(digests), span_lists(a, b, before, offs)],
                    schema=result_schema,
                )
            )
        return pa.concat_tables(tables)

    shared = blocks.mapInArrow(send_anchors, "bucket int, block long, anchors binary").groupBy("bucket").applyInArrow(judge_anchors, "block long, bucket int, n long, bits binary")
    sent = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(send_segments, "bucket int, block long, kind byte, payload binary")
    spans = sent.groupBy("bucket").applyInArrow(sort_bucket, "block long, spans binary")
    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(finish, RESULT)


def pack_spans(starts: np.ndarray, ends: np.ndarray) -> bytes:
    return join_parts([c.enc(starts.astype(np.uint32)), c.enc((ends - starts).astype(np.uint32))])


def unpack_spans(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    starts, lens = (c.dec(p, np.uint32).astype(np.int64) for p in split_parts(b))
    return starts, starts + lens


def join_parts(parts: list[bytes]) -> bytes:
    return np.array([len(parts), *map(len, parts)], np.uint32).tobytes() + b"".join(parts)


def split_parts(b: bytes) -> list[bytes]:
    n = int.from_bytes(b[:4], "little")
    sizes = np.frombuffer(b, np.uint32, n, 4).tolist()
    at, out = 4 + 4 * n, []
    for s in sizes:
        out.append(b[at : at + s])
        at += s
    return out


def op2_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    """Strings of 50 bytes over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return dedup_strings(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
