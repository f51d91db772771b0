"""Search answers as candidates for an expansion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions import text as t
from bibspark.operators import classify, dedup, enrich
from bibspark.operators import taxonomy as tx

#: What is read of an answer.
ANSWER = """results array<struct<id: string, doi: string, title: string, publication_year: int, type: string, cited_by_count: long, is_retracted: boolean,
authorships: array<struct<author: struct<display_name: string>, countries: array<string>, institutions: array<struct<display_name: string, country_code: string>>>>,
primary_location: struct<raw_source_name: string, source: struct<display_name: string, type: string, is_core: boolean>>,
topics: array<struct<display_name: string>>, keywords: array<struct<display_name: string>>, concepts: array<struct<display_name: string>>, abstract_inverted_index: map<string, array<int>>>>"""


def works_found(answers: DataFrame) -> DataFrame:
    """answers (query, raw) -> query, position and the flat fields of each result; a missing or broken
    answer has none."""
    rows = answers.select("query", F.posexplode(F.from_json("raw", ANSWER)["results"]).alias("position", "w")).select("query", "position", "w.*")
    names = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<display_name: string>>")), lambda e: e["display_name"])
    flat = enrich.normal_work(rows)
    return flat.select(
        "query", "position", F.regexp_replace("id", "^https?://openalex.org/", "").alias("openalex_id"), t.normalize_doi(F.col("doi")).alias("doi"), t.normalize_space(F.col("title")).alias("title"),
        t.from_inverted(F.col("abstract_inverted_index")).alias("abstract"), "publication_year", F.col("type").alias("work_type"), F.coalesce("cited_by_count", F.lit(0)).alias("cited_by_count"),
        F.coalesce("is_retracted", F.lit(False)).alias("is_retracted"), F.coalesce("primary_location.source.is_core", F.lit(False)).alias("is_core"), "authors", "institutions", "countries", "source_name",
        t.unite(names("topics"), names("keywords"), names("concepts")).alias("topics"), t.filled(names("topics")).alias("concepts"), t.filled(names("keywords")).alias("keywords"),
    )


def searches(answers: DataFrame) -> DataFrame:
    """Query, status, openalex_count (what the index counts), returned, retrieved_at of each answer;
    retrieved_at is NULL for answers landed without it."""
    a = F.from_json("raw", "meta struct<count: long>, results array<struct<id: string>>")
    when = F.col("retrieved_at") if "retrieved_at" in answers.columns else F.lit(None).cast("string")
    return answers.select("query", "status", a["meta"]["count"].alias("openalex_count"), F.coalesce(F.size(a["results"]), F.lit(0)).alias("returned"), when.alias("retrieved_at"))


def judged(found: DataFrame, originals: DataFrame, queries: dict[str, tuple[str, ...]] = tx.DIRECTION_QUERIES, directions=tx.EDUCATION_DIRECTIONS, reference_title: str = tx.REFERENCE_TITLE) -> DataFrame:
    """Results with direction, keys, score, in_scope and reason, NULL for what is accepted. The
    reasons go in this order: the reference title in another direction, missing metadata or
    retracted, a key of an original, out of scope, no match of the direction."""
    listed = [(q, d) for d, qs in queries.items() for q in qs]
    asked = found.sparkSession.createDataFrame([(q, d, k) for k, (q, d) in enumerate(listed)], "query string, direction string, asked int")
    rows = found.join(F.broadcast(asked), "query")  # a row a query
    rows = rows.withColumn("keys", dedup.dedup_keys(F.col("openalex_id"), F.col("doi"), t.normalize_title(F.col("title"))))
    rows = rows.withColumn("arrival", F.concat_ws("|", F.lpad(F.col("asked").cast("string"), 6, "0"), F.lpad(F.col("position").cast("string"), 6, "0"))).drop("asked")
    sections = {"title": F.col("title"), "abstract": F.coalesce("abstract", F.lit("")), "concepts": F.array_join("concepts", " ; "), "keywords": F.array_join("keywords", " ; ")}
    text = F.concat_ws(" ", "title", "abstract")  # what a direction is matched with
    rows = classify.classify(rows, tx.EDUCATION_RULES, sections, scope_text=F.concat_ws(" ", text, F.array_join("concepts", " ")))
    filled = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    is_reference = t.normalize_title(F.col("title")) == t.normalize_title(F.lit(reference_title))

    def score(d: tx.Direction) -> Column:
        return classify.direction_score(d, text, F.col("title"), F.col("primary_code"), F.col("cited_by_count"), F.col("is_core"), filled("doi"), filled("abstract"), F.size("institutions") > 0, is_reference)

    fits = reduce(lambda rest, d: F.when(F.col("direction") == d.code, score(d)).otherwise(rest), directions, F.lit(-1.0))
    fresh = dedup.anti_join_any_key(rows.select("arrival", "keys"), originals, "arrival").select("arrival", F.lit(True).alias("fresh"))
    rows = rows.withColumns({"score": F.round(fits, 3), "is_reference": is_reference}).join(fresh, "arrival", "left")
    checks = [
        ("direction_mismatch", F.col("is_reference") & (F.col("direction") != "M01")),
        ("scope_or_metadata", F.col("is_retracted") | ~filled("title") | (F.size("authors") == 0) | ~filled("source_name")),
        ("duplicate_of_original", F.col("fresh").isNull()),
        ("scope_or_metadata", ~F.col("in_scope")),
        ("direction_mismatch", F.col("score") < 0),
    ]
    return rows.withColumn("reason", classify.reject_reason(checks)).drop("fresh", "ranked")
