"""Near-dedup of word-shingle sets at a Jaccard similarity, all pairs found.

Two sets of similarity t or more hold a common element among the first n - ceil(t * n) + 1 of each
one's n elements in any order that all sets share. The order here goes by the elements' counts in a
sketch of the corpus, so that a common line comes last and hardly makes candidates; what the sketch
confuses costs time but no pair. Candidates whose histograms (elements by their leading bits) leave
room for the similarity are compared by their whole sets.

Components need no pair within what is already connected. First a key's sets are compared with one of
them only, the likely original; then, in keys that still hold several components, sets of different
components, block by block inside tasks: pairs that histograms rule out never become rows. Equal sets
are one class from the start.
"""

from __future__ import annotations

import math
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm import common as c
from bibspark.llm import simhash

SHINGLE = 5
SIMILARITY = 0.8
#: Counters of the sketch, and how many of them make a row.
SKETCH_BITS, SLICE = 21, 1 << 16
#: Leading bits of an element that choose its counter in a set's histogram; counters stop at 255.
HISTOGRAM_BITS = 8
#: Sets of one key in a block, two of which are compared at a time.
CELL = 1024
#: Bytes of text hashed at a time; the hashes take some fifty bytes for each.
CHUNK_BYTES = 1 << 20


def shingle_sets(offs: np.ndarray, buf: np.ndarray, shingle: int = SHINGLE):
    """_sets() of pieces of CHUNK_BYTES; a longer text is a piece of its own."""
    at = 0
    while at < len(offs) - 1:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + CHUNK_BYTES, side="right")) - 1)
        yield from _sets(offs[at : end + 1] - offs[at], buf[offs[at] : offs[end]], shingle)
        at = end


def _sets(offs: np.ndarray, buf: np.ndarray, shingle: int):
    """Sorted 64-bit hashes of the distinct word shingles of each lower-cased text (a shorter text is
    one shingle), and a 64-bit name of each set, signed."""
    low = c.LOWER[buf]
    starts, ends, first = c.word_spans(low, offs)
    words = c.word_hashes(low, starts, ends) if len(starts) else np.zeros(0, c.U64)
    pw = c.powers(c.BASES[1], shingle)
    rows = np.zeros(max(0, len(words) - shingle + 1), c.U64)
    for j in range(shingle):
        rows += words[j : j + len(rows)] * pw[j]
    rows = c.mix(rows)
    for k in range(len(offs) - 1):
        a, b = int(first[k]), int(first[k + 1])
        if b - a >= shingle:
            own = np.unique(rows[a : b - shingle + 1])
        else:
            own = c.mix(np.array([b - a], c.U64) + np.sum(words[a:b] * pw[: b - a], dtype=c.U64))
        yield own, int(c.mix(c.prefix_hash(own, c.BASES[2])[-1:]).view(np.int64)[0])


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - 1e-9) + 1


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) >= similarity


def _three(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), simhash.row_key().alias("row_key"))


def histogram(own: np.ndarray) -> bytes:
    n = np.bincount((own >> c.U64(64 - HISTOGRAM_BITS)).astype(np.int64), minlength=1 << HISTOGRAM_BITS)
    return np.minimum(n, 255).astype(np.uint8).tobytes()


def possible(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    """Can sets of these histograms (a row each) and sizes have the similarity? Their common elements
    are at most the sum of the lesser counters; a counter that has stopped says nothing."""
    both = np.minimum(x, y).sum(axis=1, dtype=np.int64)
    full = ((x == 255) & (y == 255)).any(axis=1)
    return full | (both >= similarity * (n + m - both) - 1e-6)


def _named_sets(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, row_key, fp (the set's name), n (its size), histogram of each row; and rows (slice,
    counts) of the sketch."""

    def run(batches):
        counts, seen = np.zeros(1 << SKETCH_BITS, np.uint32), set()
        schema = ["doc_id", "row_key", "fp", "n", "histogram", "slice", "counts"]
        for batch in batches:
            ids, offs, buf = c.batch_texts(batch)
            names, n, bars = [], [], []
            for own, name in shingle_sets(offs, buf, shingle):
                names.append(name)
                n.append(len(own))
                bars.append(histogram(own))
                if name not in seen:
                    seen.add(name)
                    np.add.at(counts, (own >> c.U64(64 - SKETCH_BITS)).astype(np.int64), 1)
            none = pa.nulls(len(ids))
            yield pa.RecordBatch.from_arrays(
                [c.id_array(ids), batch.column(2), pa.array(names, pa.int64()), pa.array(n, pa.int32()), pa.array(bars, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema
            )
        for k in range((1 << SKETCH_BITS) // SLICE) if seen else ():
            one = pa.nulls(1)
            packed = pa.array([c.enc(counts[k * SLICE : (k + 1) * SLICE])], pa.binary())
            yield pa.RecordBatch.from_arrays([*[one.cast(pa.int64())] * 3, one.cast(pa.int32()), one.cast(pa.binary()), pa.array([k], pa.int32()), packed], schema)

    return _three(docs).mapInArrow(run, "doc_id long, row_key long, fp long, n int, histogram binary, slice int, counts binary")


def _sketch(rows: DataFrame) -> np.ndarray:
    """The summed counters; their number is fixed, whatever the corpus."""

    def add(pdf):
        total = sum(c.dec(b, np.uint32).astype(np.uint64) for b in pdf["counts"])
        pdf = pdf.iloc[:1].copy()
        pdf["counts"] = [c.enc(np.minimum(total, 2**32 - 1).astype(np.uint32))]
        return pdf

    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in rows.where("slice is not null").select("slice", "counts").groupBy("slice").applyInPandas(add, "slice int, counts binary").collect():
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = c.dec(bytes(r["counts"]), np.uint32)
    return out


def _keys(docs: DataFrame, counts, shingle: int, similarity: float) -> DataFrame:
    """key, fp, n: the prefix of each set."""

    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            _, offs, buf = c.batch_texts(batch)
            keys, names, sizes = [], [], []
            for own, name in shingle_sets(offs, buf, shingle):
                if name in seen:
                    continue
                seen.add(name)
                often = counts.value[(own >> c.U64(64 - SKETCH_BITS)).astype(np.int64)]
                first = own[np.lexsort((own, often))[: prefix_size(len(own), similarity)]]
                keys.append(first.view(np.int64))
                names.append(np.full(len(first), name, np.int64))
                sizes.append(np.full(len(first), len(own), np.int32))
            if keys:
                whole = [np.concatenate(x) for x in (keys, names, sizes)]
                for at in range(0, len(whole[0]), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 18)]) for x in whole], ["key", "fp", "n"])

    return _three(docs).mapInArrow(run, "key long, fp long, n int")


def _sets_of(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """fp, elements of the sets whose row is wanted (row_key)."""

    def run(batches):
        for batch in batches:
            _, offs, buf = c.batch_texts(batch)
            found = shingle_sets(offs, buf, shingle)
            while part := list(islice(found, 256)):
                yield pa.RecordBatch.from_arrays([pa.array([name for _, name in part], pa.int64()), pa.array([own.tobytes() for own, _ in part], pa.binary())], ["fp", "elements"])

    return _three(docs).join(wanted, "row_key", "left_semi").mapInArrow(run, "fp long, elements binary").dropDuplicates(["fp"])


def _possible(pairs: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose histograms leave room for the similarity, with the rows that hold
    their sets (x_row, y_row)."""

    def run(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, 1 << HISTOGRAM_BITS) for k in (4, 5))
            n, m = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (6, 7))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "x_row", "y_row"]).filter(pa.array(possible(x, y, n, m, similarity), pa.bool_()))

    fps = own.groupBy("fp").agg(F.min(F.struct("row_key", "n", "histogram")).alias("s"))
    side = lambda name, key: fps.select(F.col("fp").alias(name), F.col("s.row_key").alias(f"{key}_row"), F.col("s.histogram").alias(key), F.col("s.n").alias(f"{key}_n"))
    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    return both.select("a", "b", "x_row", "y_row", "x", "y", "x_n", "y_n").mapInArrow(run, "a long, b long, x_row long, y_row long")


def _verified(docs: DataFrame, own: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets have the similarity, written to the shared folder."""

    def run(batches):
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            good = [similar(np.frombuffer(p, c.U64), np.frombuffer(q, c.U64), similarity) for p, q in zip(x, y, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = c.materialize(_possible(pairs, own, similarity))
    rows = left.select(F.explode(F.array("x_row", "y_row")).alias("row_key")).distinct()
    sets = c.materialize(_sets_of(docs, rows, shingle))
    x = sets.select(F.col("fp").alias("a"), F.col("elements").alias("x"))
    y = sets.select(F.col("fp").alias("b"), F.col("elements").alias("y"))
    out = c.materialize(left.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long"))
    c.discard(left, sets)
    return out


def _shared_keys(docs: DataFrame, counts, shingle: int, similarity: float) -> DataFrame:
    """key, fp, n of the keys that several sets have; of keys that the same sets have, one."""
    keys = _keys(docs, counts, shingle, similarity).repartition("key")
    several = keys.groupBy("key").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("key")
    shared = c.materialize(keys.join(several, "key").distinct())
    names = [F.sum(F.xxhash64("fp", F.lit(k)).cast("decimal(20,0)")).alias(f"names{k}") for k in (0, 1)]
    groups = shared.groupBy("key").agg(F.count("*").alias("size"), *names)
    one = groups.groupBy("size", "names0", "names1").agg(F.min("key").alias("key")).select("key")
    out = c.materialize(shared.join(one, "key", "left_semi"))
    c.discard(shared)
    return out


def _near(similarity: float):
    return F.least("m", "n") >= F.lit(similarity) * F.greatest("m", "n") - F.lit(1e-6)


def _with_hubs(shared: DataFrame, docs: DataFrame, own: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Links (a, b) of a key's sets with one of them: that which shares the most keys with the most
    sets, as an original does that others were made from."""
    size = shared.groupBy("key").agg(F.count("*").alias("size"))
    weight = shared.join(size, "key").groupBy("fp").agg(F.sum("size").alias("weight"))
    hub = F.max(F.struct("weight", "fp", "n")).alias("hub")
    hubs = shared.join(weight, "fp").groupBy("key").agg(hub).select("key", F.col("hub.fp").alias("other"), F.col("hub.n").alias("m"))
    pairs = shared.join(hubs, "key").where("fp <> other").where(_near(similarity))
    pairs = c.materialize(pairs.select(F.least("fp", "other").alias("a"), F.greatest("fp", "other").alias("b")).distinct())
    found = _verified(docs, own, pairs, shingle, similarity)
    c.discard(pairs)
    return found


def _cells(rest: DataFrame, own: DataFrame) -> DataFrame:
    """rest (key, fp, n, root) with histograms, dealt out in blocks of about CELL sets of a key, each
    block once for each block of its key: pairs of blocks meet in cells (i, j), i <= j."""
    size = rest.groupBy("key").agg(F.count("*").alias("size"))
    bars = own.groupBy("fp").agg(F.min("histogram").alias("histogram"))
    cut = rest.join(size, "key").withColumn("blocks", F.ceil(F.col("size") / CELL).cast("int"))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("fp", F.lit("block")), F.col("blocks")).cast("int"))
    each = cut.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = each.join(bars, "fp").select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "fp", "n", "root", "histogram")
    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def _apart(cells: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of sets of one key and different roots whose histograms leave room for the
    similarity. Cells are compared within a task, row by row against the rest; other pairs than
    these are not made."""

    def compare(t: pa.Table):
        block, fp, n, root = (t.column(k).to_numpy().astype(np.int64) for k in (3, 4, 5, 6))
        bars = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint8).reshape(len(fp), -1)
        one = t.column(1)[0].as_py() == t.column(2)[0].as_py()
        for k in range(len(fp) - 1):
            at = np.flatnonzero(root[k + 1 :] != root[k]) + k + 1
            at = at[np.minimum(n[at], n[k]) >= similarity * np.maximum(n[at], n[k]) - 1e-6]
            if not one:
                at = at[block[at] != block[k]]
            at = at[possible(bars[at], bars[k], n[at], n[k], similarity)] if len(at) else at
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(fp[at], fp[k])), pa.array(np.maximum(fp[at], fp[k]))], ["a", "b"])

    def run(batches):
        held = None  # the cell that the next batch may go on with
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            keys = np.stack([t.column(k).to_numpy().astype(np.int64) for k in range(3)])
            cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
            for a, b in zip([0, *cuts], cuts, strict=False):
                if b - a > 1:
                    yield from compare(t.slice(a, b - a))
            held = t.slice(cuts[-1] if len(cuts) else 0)
        if held is not None:
            yield from compare(held)

    return cells.mapInArrow(run, "a long, b long").distinct()


def links(docs: DataFrame, own: DataFrame, counts, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """Pairs (a, b) of names of sets of the given similarity or more that connect all that such pairs
    connect. own: row_key, fp, n, histogram."""
    shared = _shared_keys(docs, counts, shingle, similarity)
    found = _with_hubs(shared, docs, own, shingle, similarity)
    roots = c.components(found).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = shared.join(roots, "fp", "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("key")
    rest = c.materialize(rooted.join(apart, "key", "left_semi"))
    pairs = c.materialize(_apart(_cells(rest, own), similarity))
    more = _verified(docs, own, pairs, shingle, similarity)
    c.discard(shared, rest, pairs)
    return found.unionByName(more)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """As simhash.near_duplicates, but linked are texts whose shingle sets have the given Jaccard
    similarity or more; fp names a set. Texts without words have one set."""
    if not 0 < similarity <= 1 or shingle < 1:
        raise ValueError("similarity in (0, 1], shingle from 1")
    both = c.materialize(_named_sets(docs, shingle))
    own = both.where("slice is null").select("doc_id", "row_key", "fp", "n", "histogram")
    counts = docs.sparkSession.sparkContext.broadcast(_sketch(both))
    return simhash.linked(own.select("doc_id", "row_key", "fp"), links(docs, own, counts, shingle, similarity))


def with_fingerprints(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, max_bits: int = simhash.MAX_BITS) -> DataFrame:
    """simhash.near_duplicates, whose fingerprints are also linked where texts have the given Jaccard
    similarity or more, however many bits they differ in."""
    if not 0 < similarity <= 1 or shingle < 1:
        raise ValueError("similarity in (0, 1], shingle from 1")
    fps = c.materialize(simhash.fingerprints(docs))
    both = c.materialize(_named_sets(docs, shingle))
    own = both.where("slice is null").select("doc_id", "row_key", "fp", "n", "histogram")
    counts = docs.sparkSession.sparkContext.broadcast(_sketch(both))
    found = links(docs, own, counts, shingle, similarity)
    # a set's name stands for the least of its texts' fingerprints: texts of one set may have several
    rows = own.select("row_key", F.col("fp").alias("name")).distinct().join(fps.select("row_key", "fp").distinct(), "row_key")
    named = c.materialize(rows.select("name", "fp").distinct())
    low = named.groupBy("name").agg(F.min("fp").alias("low"))
    equal = named.join(low, "name").where("fp <> low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    side = lambda k: low.select(F.col("name").alias(k), F.col("low").alias(f"{k}_fp"))
    near = found.join(side("a"), "a").join(side("b"), "b").select(F.col("a_fp").alias("a"), F.col("b_fp").alias("b")).where("a <> b")
    return simhash.linked(fps, simhash.links(fps.select("fp").distinct(), max_bits).unionByName(equal).unionByName(near))


def keep_one(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component, all columns kept."""
    return simhash.keep_first(docs, near_duplicates(docs, shingle, similarity))
