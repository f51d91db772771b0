"""The driver's tables as works: an order is a work, its suppliers are authors, their nations
countries, the parts' brands institutions and their types topics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.sources.records import shares


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of lineitem's files whose lines a task groups: some half a million lines, which it sorts.
LINES_BYTES = 4 << 20
#: A work's fields, and the tables beside orders that they come from.
FIELDS = {
    "work_id": (), "year": (), "title": ("lineitem", "part"), "source_name": ("customer",), "work_type": (), "status": (), "authors": ("lineitem", "supplier"),
    "countries": ("lineitem", "supplier", "nation"), "institutions": ("lineitem", "part"), "topics": ("lineitem", "part"), "citations": ("lineitem",),
}


def works(spark: SparkSession, sf_dir: str, *wanted: str) -> DataFrame:
    """The wanted FIELDS of works (all by default). One aggregation by order; tables that no wanted
    field needs are not read, as the optimizer does not know that the keys below are unique and
    every line's part, supplier and nation exist."""
    t = lambda name: table(spark, sf_dir, name)
    wanted = wanted or tuple(FIELDS)
    needs = {name for f in wanted for name in FIELDS[f]}
    out = t("orders")
    if "customer" in needs:
        out = out.join(t("customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"), "left")
    if "lineitem" in needs:
        lines = t("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity")
        parts = shares(lines, LINES_BYTES)
        for name, key, own in (("part", "l_partkey", "p_partkey"), ("supplier", "l_suppkey", "s_suppkey"), ("nation", "s_nationkey", "n_nationkey")):
            if name in needs:
                lines = lines.join(t(name), F.col(key) == F.col(own))
        lines = lines.repartition(parts, "l_orderkey")  # after the joins, which may deal by other keys
        # one list of an order's lines; its fields are taken apart by functions that compile
        uses = {"title": ("l_linenumber", "l_partkey", "p_name"), "authors": ("s_name",), "countries": ("n_name",), "institutions": ("p_brand",), "topics": ("p_type",)}
        held = list(dict.fromkeys(c for f in ("title", *wanted) if f in wanted for c in uses.get(f, ())))
        labels = lambda f: F.sort_array(F.array_except(F.col("held")[uses[f][0]], F.array(F.lit(None).cast("string"))))
        sums = ([F.collect_list(F.struct(*held)).alias("held")] if held else []) + ([F.sum("l_quantity").cast("long").alias("citations")] if "citations" in wanted else [])
        by_order = lines.groupBy("l_orderkey").agg(*sums)
        of = {"title": lambda f: F.array_min("held")["p_name"], "citations": lambda f: F.col(f)}
        by_order = by_order.select("l_orderkey", *[of.get(f, labels)(f).alias(f) for f in wanted if f in uses or f in of])
        out = out.join(by_order, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    empty = F.array().cast("array<string>")
    plain = {"work_id": F.col("o_orderkey"), "year": F.year("o_orderdate"), "source_name": F.col("c_mktsegment"), "work_type": F.col("o_orderpriority"), "status": F.col("o_orderstatus")}
    filled = {"title": F.lit(""), "citations": F.lit(0).cast("long")}
    return out.select(*[(plain[f] if f in plain else F.coalesce(f, filled.get(f, empty))).alias(f) for f in wanted])


WORKS_SQL = """
WITH lines AS (
  SELECT l.*, p_name, p_brand, p_type, s_name, n_name FROM lineitem l JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey),
byorder AS (
  SELECT l_orderkey, arg_min(p_name, (l_linenumber, l_partkey)) AS title, list_sort(list(DISTINCT s_name)) AS authors,
         list_sort(list(DISTINCT n_name)) AS countries, list_sort(list(DISTINCT p_brand)) AS institutions,
         list_sort(list(DISTINCT p_type)) AS topics, sum(l_quantity)::BIGINT AS citations FROM lines GROUP BY 1),
works AS (
  SELECT o_orderkey AS work_id, year(o_orderdate)::INT AS year, coalesce(title, '') AS title, c_mktsegment AS source_name,
         o_orderpriority AS work_type, o_orderstatus AS status, coalesce(authors, []) AS authors, coalesce(countries, []) AS countries,
         coalesce(institutions, []) AS institutions, coalesce(topics, []) AS topics, coalesce(citations, 0)::BIGINT AS citations
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN byorder ON o_orderkey = l_orderkey)
"""
