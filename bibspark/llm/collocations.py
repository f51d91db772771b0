"""Collocated phrases from vertical positional inverted lists.

Texts are read in blocks. A block keeps, for each of its words, the sorted list of the positions where
it stands; positions skip a place between pieces, so that words stand side by side exactly if their
positions do. Phrases grow word by word: the occurrence list of a frequent phrase is merge-joined with
the postings of the words at the next place, and the lengths of the lists, added up over the blocks,
are exact frequencies. Only words, then pairs, that are frequent in their language are carried on.

A document's positions never leave its block. What travels is a row for each word, pair or triple of
a block with its count; words are compared as texts, and frequent ones have numbers after that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bibspark.llm.common import LOWER, U64, dec, discard, enc, materialize, mix, partitions, text_chunks, trim

MIN_COUNT = 10
#: A phrase goes if a longer one has this share of its occurrences (percent).
COVERED = 50
LIMIT = 2000
SCORE_UNIT = 1_000_000
#: Bits of the filter over frequent pairs: for each pair, and at most (16 MB). It spares triples that
#: cannot be frequent; a pair let through in error costs rows, never a wrong count.
FILTER_BITS, MAX_FILTER_BITS = 16, 1 << 27
BITMAP = 8 * 4096

#: By byte: 0 in a word, 1 between words, 2 between pieces.
KIND = np.zeros(256, np.uint8)
KIND[[0x20, 0x09]] = 1
KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2

INDEX_SCHEMA = "block long, words array<string>, langs array<string>, counts array<int>, lists binary"


# ---------------------------------------------------------------- lists of a block
def positional_lists(langs: np.ndarray, offs: np.ndarray, buf: np.ndarray):
    """Documents (language number, offsets, bytes) -> (words, language number and count of each entry,
    positions of the entries' words one list after another)."""
    low = LOWER[buf]
    kind = KIND[low]
    inside = np.concatenate([kind == 0, [False]])
    start = inside[:-1].copy()
    start[1:] &= ~inside[:-2]
    cuts = offs[(offs > 0) & (offs < len(buf))]
    start[cuts] = inside[cuts]
    starts = np.flatnonzero(start)
    if not len(starts):
        return pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
    document = np.searchsorted(offs, starts, side="right") - 1
    pieces = np.cumsum(kind == 2, dtype=np.int32)[starts] + document
    positions = (np.arange(len(starts)) + pieces).astype(np.int32)
    letters = np.concatenate([[0], np.cumsum(kind == 0, dtype=np.int32)]).astype(np.int32)
    bounds = np.append(letters[starts], letters[-1])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(low[kind == 0].tobytes())).dictionary_encode()
    n = len(words.dictionary)
    keys, entry, counts = np.unique(langs[document] * n + words.indices.to_numpy(), return_inverse=True, return_counts=True)
    order = np.argsort(entry, kind="stable")
    return words.dictionary.take(pa.array(keys % n)), keys // n, counts, positions[order]


def _index(docs: DataFrame) -> DataFrame:
    def build(batches):
        from pyspark import TaskContext

        part, names = TaskContext.get().partitionId(), {}

        def numbered():
            for batch in batches:
                codes = [names.setdefault(lang, len(names)) for lang in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(codes, pa.int64()), batch.column(1)], ["doc_id", "text"])

        for k, (codes, offs, buf) in enumerate(text_chunks(numbered())):
            words, langs, counts, positions = positional_lists(codes, offs, buf)
            if len(words):
                known = pa.array(list(names), pa.string()).take(pa.array(langs))
                one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([(part << 32) + k]), one(words), one(known), one(pa.array(counts, pa.int32())), pa.array([enc(positions, delta=True)], pa.binary())], ["block", "words", "langs", "counts", "lists"]
                )
            trim()

    return materialize(docs.mapInArrow(build, INDEX_SCHEMA))


def _frequent_lists(index: DataFrame, entries: DataFrame, words: DataFrame) -> DataFrame:
    """The lists of frequent words under the words' numbers: block, ids, sizes, lists."""
    found = entries.join(words.select("lang", "word", "id"), ["lang", "word"]).groupBy("block").agg(F.collect_list(F.struct("at", "id")).alias("found"))

    def select(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                counts = batch.column("counts")[k].values.to_numpy().astype(np.int64)
                found = batch.column("found")[k].values
                at, ids = found.field("at").to_numpy(), found.field("id").to_numpy()
                order = np.argsort(ids)
                at, ids = at[order], ids[order]
                starts = (np.cumsum(counts) - counts)[at]
                sizes = counts[at]
                take = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
                lists = dec(batch.column("lists")[k].as_py(), np.int32, delta=True)[take]
                yield pa.RecordBatch.from_pydict({"ids": [enc(ids, delta=True)], "sizes": [enc(sizes.astype(np.int32))], "lists": [enc(lists, delta=True)]})
            trim()

    both = index.select("block", "counts", "lists").join(found, "block").select("counts", "lists", "found")
    return materialize(both.mapInArrow(select, "ids binary, sizes binary, lists binary"), "uncompressed")


# ---------------------------------------------------------------- growing phrases
def merged(ids: np.ndarray, sizes: np.ndarray, lists: np.ndarray):
    """The postings of all words merged by position: the entry at each place, and whether the next
    place is taken too."""
    order = np.argsort(lists, kind="stable")
    at = lists[order]
    entry = np.repeat(np.arange(len(ids)), sizes)[order]
    return entry, at[1:] == at[:-1] + 1


def pairs_of(ids: np.ndarray, sizes: np.ndarray, lists: np.ndarray):
    """Extends words by the next word: (entries of the pairs, length of each pair's list)."""
    entry, joined = merged(ids, sizes, lists)
    keys, counts = np.unique(entry[:-1][joined] * len(ids) + entry[1:][joined], return_counts=True)
    return ids[keys // len(ids)], ids[keys % len(ids)], counts


def triples_of(ids: np.ndarray, sizes: np.ndarray, lists: np.ndarray, frequent):
    """Extends the pairs that frequent(a, b) lets through by the next word, if the pair it ends with
    is let through too."""
    entry, joined = merged(ids, sizes, lists)
    start = np.flatnonzero(joined)
    keys, pair = np.unique(entry[start] * len(ids) + entry[start + 1], return_inverse=True)
    kept = frequent(ids[keys // len(ids)], ids[keys % len(ids)])[pair]
    start, pair = start[kept], pair[kept]
    follows = np.flatnonzero(start[1:] == start[:-1] + 1)
    triples, counts = np.unique(pair[follows] * len(ids) + entry[start[follows + 1] + 1], return_counts=True)
    two, last = keys[triples // len(ids)], triples % len(ids)
    return ids[two // len(ids)], ids[two % len(ids)], ids[last], counts


def _grown(lists: DataFrame, grow, names: list[str], min_count: int) -> DataFrame:
    """Adds up the list lengths of all blocks and keeps the frequent phrases."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, sizes, places = (dec(batch.column(c)[k].as_py(), t, delta) for c, t, delta in (("ids", np.int64, True), ("sizes", np.int32, False), ("lists", np.int32, True)))
                out = grow(ids, sizes, places)
                if len(out[-1]):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], [*names, "f"])
                trim()

    rows = lists.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "f"]))
    return materialize(rows.groupBy(*names).agg(F.sum("f").alias("f")).where(F.col("f") >= min_count))


def slots(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The place of a pair in the filter."""
    return (mix(a.astype(U64) * U64(0x9E3779B97F4A7C15) + mix(b.astype(U64))) & U64(bits - 1)).astype(np.int64)


def _pair_filter(pairs: DataFrame):
    """A function (a, b) -> whether the pair may be frequent, from a bitmap of bounded size."""
    spark = pairs.sparkSession
    bits = max(BITMAP, min(MAX_FILTER_BITS, 1 << max(1, FILTER_BITS * pairs.count() - 1).bit_length()))

    def place(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"slot": slots(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits) + 1})

    slot = pairs.select("a", "b").mapInArrow(place, "slot long")
    rows = slot.groupBy(F.bitmap_bucket_number("slot").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bitmap")).collect()
    filled = np.zeros(bits // 8, np.uint8)
    for r in rows:
        filled[(r.k - 1) * BITMAP // 8 : r.k * BITMAP // 8] = np.frombuffer(r.bitmap, np.uint8)
    sent = spark.sparkContext.broadcast(filled)

    def frequent(a, b):
        at = slots(a, b, bits)
        return (sent.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    return frequent


# ---------------------------------------------------------------- scores
def _score(left: str, right: str):
    """floor(10**6 * a * a / (l * r)) in whole numbers of up to 38 digits."""
    wide = lambda c: f"cast({c} as decimal(18,0))"
    return F.expr(f"(cast({wide('a')} * {wide('a')} as decimal(32,0)) * cast({SCORE_UNIT} as decimal(7,0))) div ({wide(left)} * {wide(right)})")


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, covered: int = COVERED) -> DataFrame:
    """docs (text, lang, more) -> a row for each phrase of two or three words that stands min_count
    times or more in the texts of a language and in no longer one with `covered` percent of its
    occurrences: lang, phrase, a, l, r, n, score.

    a, l, r: occurrences of the phrase and of the parts of its lowest-scoring cut (the first of equal
    ones); n: of all words of the language. A null text is empty; a null lang counts as `und`. Repeated
    rows count as often as they stand; an empty table gives an empty result; other columns play no part."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    index = _index(texts)
    entries = index.select("block", F.posexplode(F.arrays_zip("langs", "words", "counts")).alias("at", "e")).select("block", "at", F.col("e.langs").alias("lang"), F.col("e.words").alias("word"), F.col("e.counts").alias("f"))
    totals = materialize(entries.groupBy("lang").agg(F.sum("f").alias("n")))
    words = materialize(entries.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count).withColumn("id", F.monotonically_increasing_id()))
    lists = _frequent_lists(index, entries, words)
    discard(index)
    pairs = _grown(lists, pairs_of, ["a", "b"], min_count)
    frequent = _pair_filter(pairs)
    triples = _grown(lists, lambda ids, sizes, at: triples_of(ids, sizes, at, frequent), ["a", "b", "c"], min_count)
    discard(lists)

    part = lambda key, f, name=None: words.select(F.col("id").alias(key), F.col("f").alias(f), F.col("word").alias(f"w_{key}"), *([F.col("lang")] if name else []))
    longer = triples.select("a", "b", "f").unionByName(triples.select(F.col("b").alias("a"), F.col("c").alias("b"), "f")).groupBy("a", "b").agg(F.max("f").alias("longer"))
    two = (
        pairs.join(longer, ["a", "b"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("f")))
        .join(part("a", "l", "lang"), "a").join(part("b", "r"), "b")
        .select("lang", F.concat_ws(" ", "w_a", "w_b").alias("phrase"), F.col("f").alias("a"), "l", "r").withColumn("score", _score("l", "r"))
    )
    three = (
        triples.join(pairs.select("a", "b", F.col("f").alias("f_ab")), ["a", "b"]).join(pairs.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("f_bc")), ["b", "c"])
        .join(part("a", "f_a", "lang"), "a").join(part("b", "f_b"), "b").join(part("c", "f_c"), "c")
        .select("lang", F.concat_ws(" ", "w_a", "w_b", "w_c").alias("phrase"), F.col("f").alias("a"), "f_a", "f_bc", "f_ab", "f_c")
        .withColumns({"one": _score("f_a", "f_bc"), "two": _score("f_ab", "f_c")})
        .select("lang", "phrase", "a", *[F.when(F.col("one") <= F.col("two"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (("f_a", "f_ab", "l"), ("f_bc", "f_c", "r"), ("one", "two", "score"))])
    )
    return two.unionByName(three).join(totals, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")


def best(phrases: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The first `limit` phrases of each language by score, then a, then phrase, with their rank. The
    first of parts of a language go on, so that no task sorts a language."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    hashed = phrases.withColumn("part", F.xxhash64("phrase"))
    for parts in (8 * partitions(phrases.sparkSession), 8):
        w = Window.partitionBy("lang", F.pmod("part", F.lit(parts))).orderBy(*order)
        hashed = hashed.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).drop("rank")
    ranked = hashed.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= limit)


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the best phrases of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang")
    return best(collocations(docs)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE_OP12 = r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(x, '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents)),
texts AS (SELECT lang, [w FOR w IN regexp_split_to_array(piece, '[\x20\x09]+') IF w <> ''] AS ws FROM pieces),
places AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM texts),
one AS (SELECT lang, ws[i] AS w, count(*) AS f FROM places GROUP BY ALL),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM one GROUP BY lang),
two AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, count(*) AS f FROM places WHERE i < len(ws) GROUP BY ALL HAVING count(*) >= 10),
three AS (SELECT lang, ws[i] AS w1, ws[i + 1] AS w2, ws[i + 2] AS w3, count(*) AS f FROM places WHERE i + 1 < len(ws) GROUP BY ALL HAVING count(*) >= 10),
longer AS (SELECT lang, w1, w2, max(f) AS f FROM (SELECT lang, w1, w2, f FROM three UNION ALL SELECT lang, w2, w3, f FROM three) GROUP BY ALL),
pairs AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, x.f AS l, y.f AS r, 1000000::HUGEINT * p.f * p.f // (x.f::HUGEINT * y.f) AS score
  FROM two p JOIN one x ON x.lang = p.lang AND x.w = p.w1 JOIN one y ON y.lang = p.lang AND y.w = p.w2
  LEFT JOIN longer g ON g.lang = p.lang AND g.w1 = p.w1 AND g.w2 = p.w2 WHERE g.f IS NULL OR 100 * g.f < 50 * p.f),
cut AS (
  SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, x.f AS l1, yz.f AS r1, xy.f AS l2, z.f AS r2,
    1000000::HUGEINT * t.f * t.f // (x.f::HUGEINT * yz.f) AS s1, 1000000::HUGEINT * t.f * t.f // (xy.f::HUGEINT * z.f) AS s2
  FROM three t JOIN one x ON x.lang = t.lang AND x.w = t.w1 JOIN one z ON z.lang = t.lang AND z.w = t.w3
  JOIN two xy ON xy.lang = t.lang AND xy.w1 = t.w1 AND xy.w2 = t.w2 JOIN two yz ON yz.lang = t.lang AND yz.w1 = t.w2 AND yz.w2 = t.w3),
phrases AS (
  SELECT * FROM pairs UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM cut),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM phrases)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, t.n, CAST(r.score AS BIGINT) AS score FROM ranked r JOIN total t ON t.lang = r.lang WHERE r.rank <= 2000
"""
