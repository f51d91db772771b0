"""Whole runs over canonical records (O1 - O9): each takes DataFrames and returns named result
tables, which write() stores. What several of an expansion's results need is computed once, while the
tables are built, and so are its selection and the communities of a collaboration; the rest is computed when it
is written or read."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.functions import text as t
from bibspark.operators import aggregates as agg
from bibspark.operators import classify, dedup, enrich, gates, graph, search, textgate
from bibspark.operators import taxonomy as tx
from bibspark.sources import documents, records
from bibspark.sources.shared import kept

#: Caps of the six-type graph; papers are capped by max_papers.
CAPS = {"journal": 9, "author": 12, "topic": 8, "year": 10, "citation": 5}
DIMENSIONS = ("authors", "institutions", "countries")

Tables = dict[str, DataFrame]


def classify_corpus(raw: DataFrame, rules=tx.EDUCATION_RULES, directions=tx.EDUCATION_DIRECTIONS) -> Tables:
    """O1 without expansion: classified records (corpus_id original-001 and so on in input order),
    the evidence of each rule that matches, summary (metric, key, n), countries by frequency and first seen, review queue, Markdown report
    and taxonomy."""
    r = records.numbered(raw, "__ordinal")
    searched = {"concepts": records.section_text(r, "concepts"), "keywords": records.section_text(r, "keywords"), "query": records.section_text(r, "matched_queries")}
    r = records.canonical(r.withColumns({f"__{k}": v for k, v in searched.items()}), "__ordinal", *[f"__{k}" for k in searched])
    r = r.withColumnRenamed("__ordinal", "ordinal").withColumn("corpus_id", records.ordinal_id(F.col("ordinal"), "original"))
    if "concepts" not in raw.columns:  # what else tells a record's topics stands for them
        r = r.withColumn("__concepts", F.array_join("topics", " ; "))
    text = F.concat_ws(" ", "title", "abstract")
    sections = {"title": F.coalesce("title", F.lit("")), "abstract": F.coalesce("abstract", F.lit(""))} | {k: F.col(f"__{k}") for k in searched}
    scope = F.concat_ws(" ", "title", "abstract", F.replace("__concepts", F.lit(" ; "), F.lit(" ")))
    done = classify.classify(r, rules, sections, scope_text=scope).withColumns(
        {
            "work_type": classify.work_type(F.col("work_type"), text),
            "directions": classify.directions(text, directions),
            "coverage": classify.coverage(F.lit(False), F.col("abstract").isNotNull()),
            "keys": dedup.dedup_keys(F.col("openalex_id"), t.normalize_doi(F.col("doi")), t.normalize_title(F.col("title"))),
        }
    )
    done = done.drop(*[f"__{k}" for k in searched])
    evidence = r.select("corpus_id", F.explode(classify.matched_evidence(sections, rules)).alias("code", "evidence"))
    summary = agg.corpus_summary(
        done,
        {"primary_topic": F.col("primary_code"), "direction": F.col("directions"), "confidence": F.col("confidence"), "coverage": F.col("coverage"), "country": F.col("countries")},
        {"in_scope": F.col("in_scope"), "with_institutions": F.size("institutions") > 0},
    )
    countries = agg.most_common(agg.ranking(r, "countries", ordinal="ordinal"))
    return {"classified": done, "evidence": evidence, "summary": summary, "countries": countries, "review_queue": classify.review_queue(done), "report": records.markdown(summary, "Corpus"), "taxonomy": records.taxonomy_table(raw.sparkSession, rules)}


def standard_records(raw: DataFrame, ordinal: str | None = None) -> DataFrame:
    """The 31 fields of standard records, classified where raw has no classification. ordinal:
    the column with the records' numbers, else they are numbered in input order."""
    r = records.standard(records.numbered(raw, "__ordinal"), "__ordinal") if ordinal is None else records.standard(raw, ordinal)
    sections = {"title": F.col("title"), "abstract": F.col("abstract"), "concepts": F.array_join("concepts", " ; "), "keywords": F.array_join("keywords", " ; ")}
    text = F.concat_ws(" ", "title", "abstract", F.array_join("concepts", " "))
    done = classify.classify(r, tx.EDUCATION_RULES, sections, scope_text=text)
    labels = F.create_map(*[F.lit(x) for rule in (*tx.EDUCATION_RULES, tx.EXCLUDED, tx.FALLBACK) for x in (rule.code, rule.label)])
    classification = F.struct(
        classify.work_type(F.col("work_type"), F.concat_ws(" ", "title", "abstract")).alias("work_type_normalized"), F.col("primary_code").alias("primary_topic_code"),
        F.element_at(labels, F.col("primary_code")).alias("primary_topic_label"), F.col("secondary_codes").alias("secondary_topic_codes"), classify.directions(text).alias("future_direction_codes"),
        "confidence", "in_scope",
    )
    return done.select(*r.columns, classification.alias("classification"))


def identified(raw: DataFrame) -> DataFrame:
    """corpus_id (original-001 and so on, in input order), title and keys of records."""
    r = records.canonical(records.numbered(raw, "__ordinal"), "__ordinal")
    keys = dedup.dedup_keys(F.col("openalex_id"), t.normalize_doi(F.col("doi")), t.normalize_title(F.col("title")))
    return r.select(records.ordinal_id(F.col("__ordinal"), "original").alias("corpus_id"), "title", keys.alias("keys"))


def expand_corpus(originals: DataFrame, candidates: DataFrame, quotas: list[tuple[str, int]], n_originals: int, reference_title: str) -> Tables:
    """O1 with expansion. originals: corpus_id, title, keys; candidates also direction, score,
    cited_by_count, in_scope, is_retracted, authors, source_name: the best of each key in a
    direction that no original has, by quota, and the gate."""
    fresh = dedup.anti_join_any_key(candidates, originals, "corpus_id")
    best = dedup.best_per_key(fresh, "direction", "keys", "score", "corpus_id", "title")
    order = [F.desc("score"), F.desc("cited_by_count"), t.normalize_title(F.col("title")), F.col("first_seen")]
    picked = dedup.quota_selection(best, quotas, "direction", "corpus_id", "keys", order)
    before = dict(zip((g for g, _ in quotas), accumulate((n for _, n in dedup.taken(picked, quotas, "direction")), initial=0), strict=False))
    number = F.element_at(F.create_map(*[F.lit(x) for pair in before.items() for x in pair]), F.col("direction")) + F.col("nth")
    named = picked.select("direction", "corpus_id", records.ordinal_id(number, "expanded").alias("expanded_id"))
    selected = kept(best.join(named, ["direction", "corpus_id"]).withColumn("corpus_id", F.col("expanded_id")).drop("expanded_id"))
    expanded = dedup.union(originals, selected)
    reference = t.normalize_title(F.col("title")) == t.normalize_title(F.lit(reference_title))
    checks = gates.expansion_gate(originals, selected, expanded, quotas, n_originals, reference, "corpus_id", "direction")
    return {"selected": selected, "expanded": expanded, "gate": gates.report(checks)}


def expand_from_search(originals: DataFrame, answers: DataFrame, quotas: list[tuple[str, int]] | None = None, n_originals: int = 150) -> Tables:
    """O1 from landed search answers (query, status, raw; records.replay): what each query gave, the
    selection by quota, the expanded corpus and the gate.
    originals: corpus_id, title, keys."""
    quotas = quotas or [(d.code, d.target) for d in tx.EDUCATION_DIRECTIONS]
    rows = kept(search.judged(search.works_found(answers), originals))
    log = agg.search_log(rows, "query", "reason")
    candidates = rows.where("reason is null").withColumn("corpus_id", F.concat_ws("|", "direction", "arrival"))
    return {"search_log": log, "searches": search.searches(answers), **expand_corpus(originals, candidates, quotas, n_originals, tx.REFERENCE_TITLE)}


def extract_metadata(raw: DataFrame, index: DataFrame | None = None) -> Tables:
    """O2: a row for each record; values of the index, by openalex_id, go first."""
    local = records.canonical(records.numbered(raw, "__ordinal").withColumnRenamed("__ordinal", "ordinal"), "ordinal")
    if index is None:
        return {"metadata": local.withColumn("metadata_status", F.lit("local_only"))}
    names = ("title", "publication_year", "source_name", "cited_by_count", "doi")
    lists = ("authors", "institutions")
    found = records.canonical(index).where("openalex_id is not null").groupBy("openalex_id").agg(*[F.max_by(n, F.struct("cited_by_count", "title")).alias(f"x_{n}") for n in (*names, *lists, "topics")])
    both = local.join(found.withColumn("hit", F.lit(True)), "openalex_id", "left")
    status = F.when(F.col("hit"), "ok").when(F.col("openalex_id").isNull(), "missing_openalex_ref").otherwise("not_found")
    return {
        "metadata": both.select(
            "ordinal", "openalex_id", *[F.coalesce(f"x_{n}", n).alias(n) for n in names],
            *[F.when(F.size(f"x_{n}") > 0, F.col(f"x_{n}")).otherwise(F.col(n)).alias(n) for n in lists],
            t.unite(F.coalesce("x_topics", F.array().cast("array<string>")), F.col("topics")).alias("topics"), status.alias("metadata_status"),
        )
    }


def export_mods(raw: DataFrame, done: DataFrame | None = None) -> Tables:
    """O3: an XML document for each record that the manifest `done` (doc_id, status) does not name,
    and the new manifest. doc_id is the canonical key of the record."""
    r = records.canonical(raw)
    keys = dedup.dedup_keys(F.col("openalex_id"), t.normalize_doi(F.col("doi")), t.normalize_title(F.col("title")))
    r = r.withColumn("doc_id", F.coalesce(F.array_min(keys), F.sha1(F.coalesce("title", F.lit(""))))).withColumn("year", F.col("publication_year"))
    if done is None:
        done = r.sparkSession.createDataFrame([], "doc_id string, status string")
    todo = records.pending(r, done, "doc_id")
    bad = todo.where("title is null")
    return {"mods": todo.where("title is not null").select("doc_id", records.mods(r).alias("xml")), "manifest": records.manifest(r, done.where("status = 'ok'"), bad, "doc_id")}


def collaboration(raw: DataFrame, top: int = 30, min_coverage: float = 0.2, min_multi: int = 3) -> Tables:
    """For each dimension its statistics and verdict, the visible nodes with communities and
    the edges between them."""
    r, out, stats = records.canonical(raw), {}, []
    for d in DIMENSIONS:
        edges = graph.collaboration_edges(r, d)
        nodes, kept = graph.top_induced(graph.collaboration_nodes(r, d), edges, top)
        figures = gates.with_graph_stats(gates.dimension_stats(r, d, edges), r, d, edges)
        stats.append(gates.dimension_gate(figures, min_coverage, min_multi).withColumn("dimension", F.lit(d)))
        out[f"{d}_edges"] = kept
        out[f"{d}_nodes"] = nodes.join(graph.communities(nodes, kept), "node", "left")
    for s in stats[1:]:
        stats[0] = stats[0].unionByName(s)
    return {"statistics": stats[0], **out}


def temporal_topics(raw: DataFrame, start: int, end: int, width: int = 5, max_topics: int = 36) -> Tables:
    """Annual counts, their quadratic trend, topics of the two windows (the shown ones, and all
    by frequency and first seen) and the gate."""
    r = records.canonical(records.numbered(raw, "__ordinal"), "__ordinal").withColumn("year", F.col("publication_year"))
    counts, windows = agg.annual_counts(r, start, end), agg.topic_window_counts(r, end, width, ordinal="__ordinal")
    shown = agg.with_ratio(agg.ranked(windows, max_topics, "topic", "n", "window"), "window")
    return {"annual_counts": counts, "trend": agg.quadratic_trend(counts), "topics": shown, "topic_counts": agg.most_common(windows, None, "n", "window"), "gate": gates.report(gates.temporal_gate(counts, windows, max_topics))}


def bibliometric_graph(raw: DataFrame, per_type: int = 24, min_citations: float = 0) -> Tables:
    """The heterogeneous evidence graph, its best nodes of each type, and the report."""
    r = records.canonical(records.numbered(raw, "__ordinal"), "__ordinal").withColumn("cited_by_count", F.coalesce("cited_by_count", F.lit(0)))
    one = lambda c: F.array_compact(F.array(c))
    # in the order in which the reference adds a record's nodes
    fields = {"author": F.col("authors"), "journal": one(F.col("source_name")), "year": one(F.col("publication_year").cast("string")), "topic": F.col("topics"), "affiliation": F.col("institutions")}
    nodes = graph.top_typed(graph.evidence_nodes(r, fields, "title", "cited_by_count", "__ordinal"), per_type, min_citations)
    edges = graph.induced(graph.evidence_edges(r, fields, "title", "cited_by_count"), nodes, "id")
    return {"nodes": nodes, "edges": edges, "top_nodes": graph.top_nodes(nodes), "report": gates.evidence_report(nodes, edges)}


def plan_figures(raw: DataFrame, start: int, end: int, max_papers: int = 14) -> Tables:
    """Six-type graphs of the most cited reviews and other works, and topics by years."""
    r = records.required(records.canonical(raw)).withColumn("year", F.col("publication_year"))
    is_review = classify.is_review(F.col("title"), F.coalesce("work_type", F.lit("")))
    out: Tables = {}
    for name, part in (("review", r.where(is_review)), ("other", r.where(~is_review))):
        best = part.orderBy(F.desc_nulls_last("cited_by_count"), "year", F.lower("title"), "title").limit(max_papers)
        papers = best.select(F.col("source_name").alias("journal"), "authors", F.col("topics")[0].alias("topic"), "year", t.shorten(F.col("title")).alias("paper"), t.citation_band(F.coalesce("cited_by_count", F.lit(0))).alias("band"))
        nodes = graph.six_type_nodes(papers, CAPS | {"paper": max_papers})
        edges = graph.induced(graph.six_type_edges(papers), nodes, "id")
        out |= {f"{name}_nodes": nodes, f"{name}_edges": edges, f"{name}_gate": gates.report(gates.six_type_gate(nodes, edges))}
    return out | {"topic_year": agg.topic_year_share(r, start, end)}


def check_documents(texts: DataFrame, bibliography: DataFrame | None = None, files: DataFrame | None = None, **limits) -> Tables:
    """O8."""
    return {"report": textgate.document_report(texts, bibliography, files, **limits)}


def check_folder(spark: SparkSession, folder: str, document: str | None = None, ledger: str | None = None, questions: list[str] | None = None, reports: list[str] | None = None, **limits) -> Tables:
    """O8 for the .tex files below a folder (or one of them, by its path), with the .bib files,
    graphics, ledger and figure reports that stand beside them. Names are those in the documents, or relative
    to each document's folder. Questions without a ledger are an error."""
    files = documents.scan(spark, folder)
    texts = documents.manuscripts(files)
    texts = texts if document is None else texts.where(F.endswith("doc_id", F.lit(document)))
    claims = documents.ledgers(texts, files, ledger) if ledger else None
    if questions and not ledger:
        claims = texts.select("doc_id", F.lit(0).alias("nth"), F.lit("questions without a ledger").alias("fault"), F.from_json(F.lit("{}"), documents.CLAIM).alias("c")).select("doc_id", "nth", "fault", "c.*")
    figures = documents.figure_reports(texts, files, reports) if reports else None
    return {"report": textgate.document_report(texts, files=files, claims=claims, questions=questions, figure_reports=figures, **limits)}


def screening_flow(nodes: DataFrame, edges: DataFrame) -> Tables:
    """O9, its data: the flow's tables and the gate."""
    return {"nodes": nodes, "edges": edges, "gate": gates.report(gates.flow_gate(nodes, edges))}


def with_country_labels(nodes: DataFrame) -> DataFrame:
    """N27 for the nodes of the dimension countries."""
    return enrich.with_country_name(nodes, "node")


def write(tables: Tables, folder: str, kind: str = "json") -> None:
    """A folder of JSON or Parquet files for each table."""
    for name, df in tables.items():
        getattr(df.write.mode("overwrite"), kind)(f"{folder.rstrip('/')}/{name}")
