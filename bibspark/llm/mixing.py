"""Mixing sources to target weights by systematic sampling, with DataFrame functions only.

Each document's expected copies are its source's rate = target / size. Within a source, documents
stand in one order and the copies of the one at rank k are the integer boundaries that the prefix
sum of expected copies crosses: floor(k * rate + u) - floor((k - 1) * rate + u), u being the
source's one random offset. As the rate is the same for all documents of a source, the prefix sum
is rank times rate, exactly reproducible.

The order is by size class first, so that every size is sampled at the same rate: the taken words
are off their target by less than the words of the source's longest document. Ranks need no task
that holds a whole source: a document's rank is the number of documents in earlier classes, plus
those in earlier salts of its class (both from pre-aggregated counts), plus its place within its
(source, class, salt) group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.llm.common import materialize

#: Weights by the source's rank in code point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target stops at this many times the source's size.
MAX_REPEAT = 3
SEED = "mix-1"
#: Hex digits of the salt: 16**3 groups for each source and size class.
SALT_DIGITS = 3


def word_count(text: Column) -> Column:
    """Number of runs without ASCII white space (null: 0)."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.array_remove(F.split(spaced, " +"), "")).cast("long")


def size_class() -> Column:
    """Of the column size: below 32 each stands alone; above, 16 classes for each power of two."""
    top = F.expr("shiftright(size, length(bin(size)) - 5) & 15")
    return F.when(F.col("size") < 32, F.col("size")).otherwise(F.length(F.bin("size")) * 16 + top)


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """sizes (source, source_size) -> also weight, target. The whole is shared by weight; a share
    above max_repeat times its source's size stops there and the excess goes to the others by
    weight, until none is above. In order of cap by weight the stopped ones come first: with the
    caps before it taken off the whole, a source is stopped if its share of the rest by the
    remaining weights exceeds its cap."""
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = ranked.select("source", "source_size", pick.alias("weight"), (F.col("source_size") * F.lit(max_repeat)).cast("double").alias("cap"))
    every = Window.partitionBy()
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (
        w.withColumn("whole", F.sum("source_size").over(every))
        .withColumn("rest", F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("unit", F.col("rest") / F.sum("weight").over(onward))
        .withColumn("free", F.col("unit") * F.col("weight") <= F.col("cap"))
        .withColumn("level", F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source", F.col("unit").alias("unit")))).over(every)["unit"])
    )
    return level.select("source", "source_size", "weight", F.least(F.col("cap"), F.col("level") * F.col("weight")).alias("target"))


def ranks(sized: DataFrame, weights=WEIGHTS, max_repeat: float = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """sized (doc_id, source, size, key) -> also source_size, target, rate, u and rank, a document's
    place in its source's order. Rows of one key follow each other."""
    group = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    docs = sized.select("doc_id", "source", "size", "key", group.alias("grp"), size_class().alias("cls"), F.substring("key", 1, SALT_DIGITS).alias("salt"))
    counts = docs.groupBy("grp", "cls", "salt").agg(F.count("*").alias("n"))
    salts = counts.withColumn("in_class", F.sum("n").over(Window.partitionBy("grp", "cls").orderBy("salt")) - F.col("n")).withColumnRenamed("n", "n_salt")
    classes = counts.groupBy("grp", "cls").agg(F.sum("n").alias("n")).withColumn("before", F.sum("n").over(Window.partitionBy("grp").orderBy("cls")) - F.col("n")).drop("n")
    shares = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    shares = shares.withColumn("grp", group).select(
        "grp", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"), offset(seed).alias("u")
    )
    starts = salts.join(classes, ["grp", "cls"]).join(shares, "grp").select("grp", "cls", "salt", (F.col("before") + F.col("in_class")).alias("skip"), "source_size", "target", "rate", "u")
    place = F.row_number().over(Window.partitionBy("grp", "cls", "salt").orderBy("size", F.col("doc_id").asc_nulls_last(), "key"))
    ranked = docs.withColumn("place", place).join(starts, ["grp", "cls", "salt"]).withColumn("rank", F.col("skip") + F.col("place"))
    return ranked.select("doc_id", "source", "size", "key", "source_size", "target", "rate", "u", "rank")


def mix(sized: DataFrame, weights=WEIGHTS, max_repeat: float = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """sized (doc_id, source, size, key) -> doc_id, source, size, source_size, target, copies, taken.

    A null source is one source, last in order; null doc_ids and repeated rows are documents like
    others; documents without words count as size 0 and take no words; an empty table gives an
    empty result. The same rows give the same copies in every run.
    """
    out = ranks(sized, weights, max_repeat, seed).withColumn("copies", crossed(F.col("rank")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies").withColumn("taken", F.col("copies") * F.col("size"))


def offset(seed: str) -> Column:
    """The random offset, 0 to 1, of the source in the column grp."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}-"), F.col("grp")).cast("binary")), 1, 8)
    return F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)


def crossed(rank: Column) -> Column:
    """Integer boundaries that the step to this rank crosses in the prefix sum of expected copies."""
    return F.floor(rank * F.col("rate") + F.col("u")) - F.floor((rank - 1) * F.col("rate") + F.col("u"))


def document_key() -> Column:
    """128 bits of doc_id, source and text, in hex digits; rows that share them are copies throughout."""
    parts = [F.coalesce(F.concat(F.lit(k), F.col(n).cast("string")), F.lit("n")) for k, n in (("d", "doc_id"), ("s", "source"), ("t", "text"))]
    return F.md5(F.concat_ws(" ", *parts).cast("binary"))


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), document_key().alias("key"))


def mix_documents(docs: DataFrame, weights=WEIGHTS, max_repeat: float = MAX_REPEAT, seed: str = SEED) -> DataFrame:
    """The mix itself: docs with each row as often as it is taken, columns unchanged, whatever their
    names. Words are counted once and texts move once. Of rows that agree in doc_id, source and text
    (nulls too) it is open which is taken how often, if other columns tell them apart."""
    plan = ranks(materialize(sizes(docs)), weights, max_repeat, seed)
    plan = plan.groupBy("key").agg((F.min("rank") - 1).alias("skip"), F.count("*").alias("n"), F.min("rate").alias("rate"), F.min("u").alias("u"))
    # a key that nothing of is taken is left out before texts are read
    plan = plan.where(F.floor((F.col("skip") + F.col("n")) * F.col("rate") + F.col("u")) > F.floor(F.col("skip") * F.col("rate") + F.col("u")))
    rows = docs.select(F.struct("*").alias("row"), document_key().alias("key"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    taken = rows.withColumn("nth", nth).join(plan, "key").withColumn("copies", crossed(F.col("skip") + F.col("nth")))
    each = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select("row", each.alias("copy")).select("row.*")


def op1_source_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents, weights 5, 2, 1 by source in code point order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(materialize(sizes(docs))).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE_OP1 = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         coalesce('s' || source, 'n') AS grp,
         md5(coalesce('d' || doc_id, 'n') || ' ' || coalesce('s' || source, 'n') || ' ' || coalesce('t' || text, 'n')) AS key FROM documents),
k AS (
  SELECT *, CASE WHEN size < 32 THEN size
                 ELSE length(bin(size)) * 16 + ((size >> (length(bin(size)) - 5)) & 15) END AS cls FROM d),
s AS (SELECT source, any_value(grp) AS grp, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight,
             (source_size * 3)::DOUBLE AS cap, sum(source_size) OVER () AS whole FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS nth,
             whole - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS onward FROM w),
l AS (SELECT rest / onward AS level FROM o WHERE rest / onward * weight <= cap ORDER BY nth LIMIT 1),
t AS (SELECT grp, source_size, least(cap, level * weight) AS target,
             CASE WHEN source_size > 0 THEN least(cap, level * weight) / source_size ELSE 0 END AS rate FROM o, l),
r AS (SELECT doc_id, k.size, k.grp, row_number() OVER (PARTITION BY k.grp ORDER BY cls, substr(key, 1, 3), k.size, doc_id NULLS LAST, key) AS rnk FROM k),
u AS (SELECT grp, ('0x' || substr(md5('mix-1-' || grp), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM t)
SELECT doc_id, size, source_size, target,
       (floor(rnk * rate + u) - floor((rnk - 1) * rate + u))::BIGINT * size AS taken,
       (floor(rnk * rate + u) - floor((rnk - 1) * rate + u))::BIGINT AS copies
FROM r JOIN t USING (grp) JOIN u USING (grp)
"""
