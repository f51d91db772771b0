"""Declarative gates (V1 - V7, V9). A gate is a one-row table of boolean checks; report() adds the
names of those that fail and the verdict."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions.text import PLACEHOLDERS
from bibspark.operators import dedup, graph


def report(checks: DataFrame) -> DataFrame:
    """One row: the checks, errors (array), passed."""
    names = checks.columns
    errors = F.array_compact(F.array(*[F.when(~F.coalesce(F.col(n), F.lit(False)), n) for n in names]))
    return checks.withColumn("errors", errors).withColumn("passed", F.size("errors") == 0)


def long_form(checks: DataFrame) -> DataFrame:
    """check, passed: a row for each."""
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.coalesce(F.col(n), F.lit(False)).alias("passed")) for n in checks.columns])
    return checks.select(F.inline(pairs))


def corpus_gate(df: DataFrame, known: DataFrame, originals: int, target: int, required: list[str], reference: Column) -> DataFrame:
    """V1 over rows with record_origin, in_scope, is_retracted, is_duplicate and the required columns.
    known: the table of originals, of which the corpus must hold as many rows. The number of
    originals is a parameter."""
    filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in required])
    is_new = F.col("record_origin") != "original"
    checks = df.agg(
        F.count_if(~is_new).alias("__old"),
        (F.count_if(~is_new) == originals).alias("originals"),
        (F.count_if(is_new) >= target).alias("target_met"),
        (F.count_if(F.col("is_duplicate")) == 0).alias("no_duplicates"),
        F.coalesce(F.bool_and("in_scope"), F.lit(True)).alias("all_in_scope"),
        (F.count_if("is_retracted") == 0).alias("none_retracted"),
        F.coalesce(F.bool_and(filled), F.lit(True)).alias("required_metadata"),
        (F.count_if(reference) == 1).alias("reference_once"),
    )
    both = checks.crossJoin(known.agg(F.count("*").alias("__known")))  # one row each
    return both.withColumn("additive", F.col("__old") == F.col("__known")).drop("__old", "__known")


def expansion_gate(originals: DataFrame, selected: DataFrame, expanded: DataFrame, quotas: list[tuple[str, int]], n_originals: int, reference: Column, id_col: str, group: str, keys: str = "keys") -> DataFrame:
    """V1, all ten checks, in one row: originals, and the selected additions with group, keys (of
    dedup_keys), in_scope, is_retracted, title, authors and source_name. reference: the condition
    that exactly one addition meets."""
    filled = (F.coalesce("title", F.lit("")) != "") & (F.coalesce(F.size("authors"), F.lit(0)) > 0) & (F.coalesce("source_name", F.lit("")) != "")
    additions = selected.agg(
        (F.count("*") == sum(n for _, n in quotas)).alias("target_met"),
        F.coalesce(F.bool_and(F.coalesce("in_scope", F.lit(False))), F.lit(True)).alias("all_in_scope"),
        (F.count_if("is_retracted") == 0).alias("none_retracted"),
        F.coalesce(F.bool_and(filled), F.lit(True)).alias("required_metadata"),
        (F.count_if(reference) == 1).alias("reference_once"),
    )
    spine = selected.sparkSession.createDataFrame(quotas, f"`{group}` string, quota long")
    counts = selected.groupBy(group).agg(F.count("*").alias("n")).join(spine, group, "full")
    none = lambda df, name: df.agg((F.count("*") == 0).alias(name))
    known = dedup.anti_join_any_key(selected, originals, id_col, keys)
    parts = [
        originals.agg((F.count("*") == n_originals).alias("originals")),
        additions,
        expanded.agg(F.count("*").alias("all")).crossJoin(originals.unionByName(selected, allowMissingColumns=True).agg(F.count("*").alias("parts"))).select((F.col("all") == F.col("parts")).alias("additive")),
        none(counts.where(~F.col("n").eqNullSafe(F.col("quota"))), "quotas_met"),
        none(selected.join(known.select(id_col), id_col, "left_anti"), "no_cross_duplicates"),
        none(dedup.incremental_duplicates(selected, id_col, keys).where("is_duplicate"), "no_within_duplicates"),
    ]
    return reduce(lambda a, b: a.crossJoin(b), parts)  # one row each


def six_type_gate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """V3, the part that concerns data: nodes (type, label), edges (type)."""
    unnamed = F.coalesce(F.lower(F.trim("label")), F.lit("")).isin("", *PLACEHOLDERS)
    n = nodes.agg((F.count_if(unnamed) == 0).alias("no_unnamed_nodes"), (F.size(F.collect_set("type")) == 6).alias("all_node_types"))
    return n.crossJoin(edges.agg((F.size(F.collect_set("type")) == 6).alias("all_edge_types")))  # one row each


def evidence_report(nodes: DataFrame, edges: DataFrame, types=("author", "affiliation", "journal", "topic", "year")) -> DataFrame:
    """G3, one row: nodes by type, nodes and edges, what there must be, and the verdict."""
    by_type = nodes.agg(*[F.count_if(F.col("type") == k).alias(f"{k}_nodes") for k in types], F.count("*").alias("nodes"))
    both = by_type.crossJoin(edges.agg(F.count("*").alias("edges")))  # one row each
    must = {f"has_{k}_nodes": F.col(f"{k}_nodes") > 0 for k in ("author", "topic", "affiliation")}
    return both.withColumns(must).withColumn("passed", (F.col("nodes") > 0) & (F.col("edges") > 0))


def quota_gate(selected: DataFrame, group: str, quotas: list[tuple[str, int]]) -> DataFrame:
    """Per-group quotas: group, n, quota, complete."""
    spine = selected.sparkSession.createDataFrame(quotas, f"`{group}` string, quota int")
    counts = selected.groupBy(group).agg(F.count("*").alias("n"))
    return spine.join(counts, group, "left").select(group, F.coalesce("n", F.lit(0)).alias("n"), "quota", (F.coalesce("n", F.lit(0)) >= F.col("quota")).alias("complete"))


def dimension_stats(works: DataFrame, values: str, edges: DataFrame) -> DataFrame:
    """A8 without the graph's figures, one row."""
    w = works.agg(
        F.count("*").alias("records"), F.count_if(F.size(values) > 0).alias("records_with_field"), F.count_if(F.size(F.array_distinct(values)) > 1).alias("multi_party")
    ).withColumn("coverage", F.when(F.col("records") > 0, F.col("records_with_field") / F.col("records")).otherwise(F.lit(0.0)))
    e = edges.agg(F.count("*").alias("edges"), F.coalesce(F.sum("weight"), F.lit(0)).alias("weighted_edges"))
    return w.crossJoin(F.broadcast(e))  # one row each


def with_graph_stats(stats: DataFrame, works: DataFrame, values: str, edges: DataFrame) -> DataFrame:
    """Stats with unique_nodes, connected_nodes and components of the whole graph."""
    unique = works.select(F.explode(values).alias("v")).agg(F.count_distinct("v").alias("unique_nodes"))
    parts = graph.components(edges).agg(F.count("*").alias("connected_nodes"), F.count_distinct("component").alias("components"))
    return stats.crossJoin(F.broadcast(unique)).crossJoin(F.broadcast(parts))  # one row each


def dimension_gate(stats: DataFrame, min_coverage: float = 0.2, min_multi: int = 3) -> DataFrame:
    """V2: stats with reasons (joined) and passed."""
    reasons = F.concat_ws("; ", F.when(F.col("coverage") < min_coverage, "coverage"), F.when(F.col("multi_party") < min_multi, "multi_party"), F.when(F.col("edges") < 1, "no_edges"))
    return stats.withColumn("reasons", reasons).withColumn("passed", F.col("reasons") == "")


def temporal_gate(counts: DataFrame, windows: DataFrame, max_topics: int = 36) -> DataFrame:
    """V4 over annual counts (n) and window counts (window, topic, n)."""
    c = counts.agg((F.coalesce(F.sum("n"), F.lit(0)) > 0).alias("years_have_records"))
    has = lambda w: (F.count_if(F.col("window") == w) > 0).alias(f"{w}_has_topics")
    distinct = F.count_distinct("topic")
    return c.crossJoin(F.broadcast(windows.agg(has("recent"), has("earlier"), (F.least(distinct, F.lit(max_topics)) >= F.least(F.lit(10), distinct, F.lit(max_topics))).alias("labels_covered"))))  # one row each


def ledger_errors(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """V5: claims (claim_id, claim, sources, evidence, confidence) and sources (key) ->
    claim_id, error."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    own = claims.select(
        "claim_id",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(F.coalesce(F.trim("claim_id"), F.lit("")) == "", "claim_id"),
                    F.when(F.coalesce(F.trim("claim"), F.lit("")) == "", "claim"),
                    F.when(size("sources") <= 0, "sources"),
                    F.when(size("evidence") <= 0, "evidence"),
                    F.when(~F.coalesce(F.col("confidence").isin("high", "medium", "low"), F.lit(False)), "confidence"),
                )
            )
        ).alias("error"),
    )
    asked = claims.select("claim_id", F.explode("sources").alias("key"))
    return own.unionByName(asked.join(sources, "key", "left_anti").select("claim_id", F.lit("unresolved_source").alias("error")).distinct())


def questions_covered(claims: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions (rq) and whether a claim's id is theirs or begins with it and a hyphen."""
    named = claims.select(F.explode(F.array_distinct(F.array(F.col("claim_id"), F.substring_index("claim_id", "-", 1), F.substring_index("claim_id", "-", 2)))).alias("rq")).distinct().withColumn("covered", F.lit(True))
    return questions.join(named, "rq", "left").select("rq", F.coalesce("covered", F.lit(False)).alias("covered"))


#: Nodes of each kind, and edges, that a screening flow has.
FLOW_KINDS, FLOW_EDGES = {"stage": 3, "strategy": 2, "step": 4}, 8


def flow_counts(nodes: DataFrame, edges: DataFrame, kinds: dict[str, int] = FLOW_KINDS, n_edges: int = FLOW_EDGES) -> DataFrame:
    """V7, one row: whether a flow has so many nodes of each kind and so many edges."""
    own = nodes.agg(*[(F.count_if(F.col("kind") == k) == n).alias(f"{k}_count") for k, n in kinds.items()])
    return own.crossJoin(edges.agg((F.count("*") == n_edges).alias("edge_count")))  # one row each


def flow_gate(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """V7 over flow nodes (id, kind, n) and edges (src, dst, style, n): endpoints known, styles
    allowed, and (new) flow is conserved: what leaves a node is what it holds, where it has exits."""
    known = nodes.select(F.col("id").alias("end"))
    stray = edges.join(known, edges["src"] == F.col("end"), "left_anti").unionByName(edges.join(known, edges["dst"] == F.col("end"), "left_anti"))
    out = edges.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("leaves"))
    leak = nodes.join(out, "id").where(F.col("leaves") != F.col("n"))
    one = lambda df, name: df.agg((F.count("*") == 0).alias(name))
    return one(stray, "endpoints_known").crossJoin(one(edges.where("style not in ('arrow', 'line')"), "styles")).crossJoin(one(leak, "conserved"))  # one row each


def consistency_gate(counts: dict[str, DataFrame]) -> DataFrame:
    """V9: each table has as many rows as the first."""
    tables = [df.agg(F.count("*").alias(k)) for k, df in counts.items()]
    first, *names = counts
    return reduce(lambda a, b: a.crossJoin(b), tables).select(*[(F.col(n) == F.col(first)).alias(n) for n in names])  # one row each
