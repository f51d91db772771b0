"""Counts, trends and windows of years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibspark.functions.text import unroll


def annual_counts(works: DataFrame, start: int, end: int) -> DataFrame:
    """A2: every year of the range, zero-filled."""
    spine = works.sparkSession.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("year"))
    counts = works.where(F.col("year").between(start, end)).groupBy("year").agg(F.count("*").alias("n"))
    return spine.join(F.broadcast(counts), "year", "left").select("year", F.coalesce("n", F.lit(0)).cast("long").alias("n"))  # a row a year


def quadratic_trend(counts: DataFrame) -> DataFrame:
    """A3: n = a year**2 + b year + c by least squares, and R2 (1 if n does not vary). The power sums
    are those of the year less its mean, solved by Cramer's rule and turned back to the year. With
    fewer than three years a and b are 0 and c is the sum of the three moments of n over
    max(1, sum of fourth powers). Without rows all are NULL."""
    x = F.col("year") - F.avg("year").over(Window.partitionBy())
    rows = counts.select(x.alias("x"), F.col("n").cast("double").alias("y"), F.avg("n").over(Window.partitionBy()).alias("m"))
    p = lambda k: F.pow("x", F.lit(float(k)))
    s = rows.agg(
        F.count("*").cast("double").alias("s0"), F.sum("x").alias("s1"), F.sum(p(2)).alias("s2"), F.sum(p(3)).alias("s3"), F.sum(p(4)).alias("s4"),
        F.sum("y").alias("t0"), F.sum(F.col("x") * F.col("y")).alias("t1"), F.sum(p(2) * F.col("y")).alias("t2"),
    )
    det = "(s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2))"
    a = f"(t0*(s2*s4-s3*s3) - s1*(t1*s4-t2*s3) + s2*(t1*s3-t2*s2)) / {det}"
    b = f"(s0*(t1*s4-t2*s3) - t0*(s1*s4-s2*s3) + s2*(s1*t2-s2*t1)) / {det}"
    c = f"(s0*(s2*t2-s3*t1) - s1*(s1*t2-s2*t1) + t0*(s1*s3-s2*s2)) / {det}"
    solved = f"s0 >= 3 and abs({det}) > 1e-9"
    fit = s.selectExpr(f"case when {solved} then {a} else (t0 + t1 + t2) / greatest(1, s4) end a", f"case when {solved} then {b} else 0 end b", f"case when {solved} then {c} else 0 end c")
    off = rows.crossJoin(F.broadcast(fit)).agg(  # fit is one row
        F.first("a").alias("a"), F.first("b").alias("b"), F.first("c").alias("c"),
        F.sum(F.pow(F.col("y") - F.col("a") - F.col("b") * F.col("x") - F.col("c") * F.col("x") * F.col("x"), F.lit(2.0))).alias("rest"),
        F.sum(F.pow(F.col("y") - F.col("m"), F.lit(2.0))).alias("total"),
    )
    centre = counts.agg(F.avg("year").alias("centre"))
    return off.crossJoin(centre).select(  # one row each
        F.col("c").alias("a"), (F.col("b") - 2 * F.col("c") * F.col("centre")).alias("b"), (F.col("a") - F.col("b") * F.col("centre") + F.col("c") * F.col("centre") * F.col("centre")).alias("c"),
        F.when(F.col("total") == 0, F.lit(1.0)).otherwise(1 - F.col("rest") / F.col("total")).alias("r2"),
    )


def last_complete_year(works: DataFrame, this_year: int) -> DataFrame:
    """Year, the last that has works and is over in this_year; one row."""
    return works.where(F.col("year") < this_year).agg(F.max("year").alias("year"))


def spread(works: DataFrame, group: str, value: str) -> DataFrame:
    """Median and population variance of a value."""
    return works.groupBy(group).agg(F.median(value).alias(f"median_{value}"), F.var_pop(value).alias("variance"))


def top_of_parts(works: DataFrame, part: str, caps: dict, order: list) -> DataFrame:
    """T4: the first rows of each part, as many as its cap says (none without one), with their rank."""
    cap = F.element_at(F.create_map(*[F.lit(x) for pair in caps.items() for x in pair]), F.col(part))
    ranks = works.withColumn("rank", F.row_number().over(Window.partitionBy(part).orderBy(*order)))
    return ranks.where(F.col("rank") <= max(caps.values())).where(F.col("rank") <= cap)


def first_items(df: DataFrame, group: str, value: str, order: str, k: int) -> DataFrame:
    """The first k values of each group as an array, for a report."""
    cut = df.withColumn("__rank", F.row_number().over(Window.partitionBy(group).orderBy(order, value))).where(F.col("__rank") <= k)
    return cut.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", F.col(value).alias("v")))), lambda e: e["v"]).alias("items"))


def window_of(year: Column, end: int, width: int = 5) -> Column:
    """Recent, earlier or NULL; end is the last complete year."""
    return F.when(year.between(end - width + 1, end), "recent").when(year.between(end - 2 * width + 1, end - width), "earlier")


def topic_window_counts(works: DataFrame, end: int, width: int = 5, topics: str = "topics", ordinal: str | None = None) -> DataFrame:
    """A4. ordinal: the column with the works' numbers; first_seen then tells where a topic of the
    window first stands."""
    given = [F.col(ordinal).alias("__o")] if ordinal else []
    rows = works.select(window_of(F.col("year"), end, width).alias("window"), *given, F.posexplode(topics).alias("__place", "topic")).where("window is not null")
    first = [F.min(F.struct(F.col("__o").alias("ordinal"), F.col("__place").alias("place"))).alias("first_seen")] if ordinal else []
    return rows.groupBy("window", "topic").agg(F.count("*").alias("n"), *first)


def most_common(counts: DataFrame, k: int | None = None, value: str = "n", *groups: str) -> DataFrame:
    """Counts with first_seen, ranked (in each group) by value descending, then first seen."""
    ranks = counts.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(value), "first_seen")))
    return ranks if k is None else ranks.where(F.col("rank") <= k)


def with_ratio(counts: DataFrame, group: str, value: str = "n") -> DataFrame:
    """Value scaled between the least and the largest of its group (1 if they are equal)."""
    w = Window.partitionBy(group)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return counts.withColumn("ratio", F.when(high == low, F.lit(1.0)).otherwise((F.col(value) - low) / (high - low)))


def ranked(df: DataFrame, k: int, label: str, value: str = "n", *groups: str) -> DataFrame:
    """Value descending, lower(label) and label ascending; the k first (of each group)."""
    order = [F.desc(value), F.lower(label), F.col(label)]
    if not groups:
        return df.orderBy(*order).limit(k)
    w = Window.partitionBy(*groups).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topic_year_share(works: DataFrame, start: int, end: int, k: int = 8, topics: str = "topics") -> DataFrame:
    """A5: the k most frequent topics by dense years: n and its share of all works of the year."""
    inside = works.where(F.col("year").between(start, end))
    pairs = inside.select("year", F.explode(topics).alias("topic")).groupBy("topic", "year").agg(F.count("*").alias("n"))
    top = ranked(pairs.groupBy("topic").agg(F.sum("n").alias("n")), k, "topic").select("topic")
    years = annual_counts(works, start, end).withColumnRenamed("n", "total")
    grid = top.crossJoin(F.broadcast(years))  # k rows by the years of the range
    out = grid.join(pairs, ["topic", "year"], "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    return out.select("topic", "year", "n", F.when(F.col("total") > 0, F.col("n") / F.col("total")).otherwise(F.lit(0.0)).alias("share"))


def ranking(works: DataFrame, column: str, k: int | None = None, ordinal: str | None = None) -> DataFrame:
    """Frequency of a label or of an array's labels. ordinal: the column with the works' numbers;
    equal counts then go by where the label was first seen, not by the label."""
    array = works.schema[column].dataType.typeName() == "array"
    given = [F.col(ordinal).alias("__o")] if ordinal else []
    rows = works.select(*given, F.posexplode(column).alias("__place", "label") if array else F.col(column).alias("label"))
    first = [F.min(F.struct(F.col("__o").alias("ordinal"), *([F.col("__place").alias("place")] if array else []))).alias("first_seen")] if ordinal else []
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), *first)
    if k is None:
        return counts
    return counts.orderBy(F.desc("n"), "first_seen").limit(k) if ordinal else ranked(counts, k, "label")


def corpus_summary(works: DataFrame, dimensions: dict[str, Column], flags: dict[str, Column]) -> DataFrame:
    """A1 in one pass: metric, key, n. A dimension is a label or an array of labels, NULL being
    '<missing>'; a flag is counted where true."""
    def one(name: str, c: Column) -> Column:
        return F.struct(F.lit(name).alias("metric"), F.coalesce(c.cast("string"), F.lit("<missing>")).alias("key"))

    def each(name: str, c: Column) -> Column:
        return F.transform(F.array_distinct(c), lambda v: one(name, v))

    parts = []
    for name, c in dimensions.items():
        is_array = works.select(c.alias("x")).schema["x"].dataType.typeName() == "array"
        parts.append(each(name, c) if is_array else F.array(one(name, c)))
    for name, c in flags.items():
        parts.append(F.when(c, F.array(F.struct(F.lit(name).alias("metric"), F.lit("true").alias("key")))).otherwise(F.array().cast("array<struct<metric:string,key:string>>")))
    return unroll(works, array=F.concat(*parts), key="metric").groupBy("metric", "key").agg(F.count("*").alias("n"))


def search_log(df: DataFrame, query: str, reason: str) -> DataFrame:
    """Rows returned, accepted and rejected by reason, for each query."""
    return df.groupBy(query, F.coalesce(F.col(reason), F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("n"))
