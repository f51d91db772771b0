"""Runs that ask remote indexes (O2, O3): answers are landed first, and only landed answers are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions import text as t
from bibspark.operators import enrich
from bibspark.sources import records, remote

#: What is read of a Crossref message and of an index record.
NAMED = "array<struct<display_name: string>>"
PARTS = "struct<`date-parts`: array<array<int>>>"
CROSSREF = (
    f"DOI string, type string, publisher string, title array<string>, subtitle array<string>, `container-title` array<string>, abstract string, volume string, issue string, page string, "
    f"ISSN array<string>, ISBN array<string>, author array<struct<given: string, family: string>>, `published-print` {PARTS}, `published-online` {PARTS}, published {PARTS}"
)
INDEX = (
    "id string, doi string, title string, type string, publication_date string, publication_year int, cited_by_count long, abstract_inverted_index map<string, array<int>>, "
    "authorships array<struct<author: struct<display_name: string>, institutions: array<struct<display_name: string>>, countries: array<string>>>, "
    "primary_location struct<landing_page_url: string, source: struct<display_name: string>>, best_oa_location struct<pdf_url: string>, "
    "biblio struct<volume: string, issue: string, first_page: string, last_page: string>, primary_topic struct<display_name: string>, "
    f"topics {NAMED}, keywords {NAMED}, concepts {NAMED}"
)
METADATA = ("index", "title", "authors", "author_affiliations", "institutions", "journal", "year", "topics", "cited_by_count", "doi", "openalex_id", "metadata_status")


def _given(df: DataFrame, name: str, kind: str = "string") -> Column:
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def _listed(df: DataFrame, name: str) -> Column:
    """A field as a list: an array, or text parted by semicolons."""
    empty = F.array().cast("array<string>")
    if name not in df.columns:
        return empty
    array = df.schema[name].dataType.typeName() == "array"
    if array:
        return F.coalesce(t.filled(F.col(name).cast("array<string>")), empty)
    text = F.col(name).cast("string")  # where other records have text, a list was read as its JSON
    listed = F.when(F.startswith(F.trim(text), F.lit("[")), t.filled(F.from_json(text, "array<string>")))
    return F.coalesce(listed, t.split_semicolon(text), empty)


def _names(c: Column) -> Column:
    return F.coalesce(t.filled(F.transform(c, lambda e: e["display_name"])), F.array().cast("array<string>"))


def _local(raw: DataFrame) -> DataFrame:
    """index and the fields of records that the runs use, under the names l_..."""
    rows = records.numbered(raw, "index")
    return rows.select(
        "index", *[_given(rows, n).alias(f"l_{n}") for n in ("title", "abstract", "source_name", "openalex_id", "work_type", "publication_year", "landing_page_url", "oa_url", "pdf_url", "cited_by_count")],
        t.normalize_doi(_given(rows, "doi"), corpus=False).alias("l_doi"), *[_listed(rows, n).alias(f"l_{n}") for n in ("authors", "concepts")],
    )


def metadata(raw: DataFrame, landing: str, email: str = "", index_base: str | None = None, **how) -> DataFrame:
    """O2: METADATA of each record, in the columns' order; author_affiliations is an array of name,
    institutions and countries. A record is `ok` with an answer of the index, `local_only` without an id
    or DOI, else it has the status of its request."""
    rows = _local(raw)
    base = {"base": index_base} if index_base else {}
    rows = rows.withColumn("url", remote.index_url(F.col("l_openalex_id"), F.col("l_doi"), email, **base))
    answers = remote.fetch(rows.select(F.col("url").alias("key"), "url"), landing, **how)
    found = rows.join(answers.select(F.col("key").alias("url"), "status", F.when(F.col("status") == "ok", F.from_json("raw", INDEX)).alias("w")), "url", "left")
    w = F.col("w")
    hit = w.isNotNull()
    authors = F.filter(w["authorships"], lambda a: F.coalesce(F.trim(a["author"]["display_name"]), F.lit("")) != "")
    one = lambda a: F.struct(F.trim(a["author"]["display_name"]).alias("name"), t.distinct_ci(_names(a["institutions"])).alias("institutions"), t.distinct_ci(F.coalesce(t.filled(a["countries"]), F.array().cast("array<string>"))).alias("countries"))
    none = F.array().cast("array<string>")
    local = F.transform("l_authors", lambda n: F.struct(n.alias("name"), none.alias("institutions"), none.alias("countries")))
    found = found.withColumn("author_affiliations", F.coalesce(F.when(hit, F.coalesce(F.transform(authors, one), F.slice(local, 1, 0))), local))
    return found.select(
        "index", t.first_text(w["title"], F.col("l_title")).alias("title"), F.transform("author_affiliations", lambda a: a["name"]).alias("authors"), "author_affiliations",
        t.distinct_ci(F.flatten(F.transform("author_affiliations", lambda a: a["institutions"]))).alias("institutions"), t.first_text(w["primary_location"]["source"]["display_name"], F.col("l_source_name")).alias("journal"),
        F.coalesce(w["publication_year"].cast("string"), "l_publication_year").alias("year"),
        t.distinct_ci(F.concat(t.filled(F.array(F.coalesce(w["primary_topic"]["display_name"], F.lit("")))), _names(w["topics"]), _names(w["keywords"]), _names(w["concepts"]), F.col("l_concepts"))).alias("topics"),
        F.coalesce(w["cited_by_count"].cast("string"), "l_cited_by_count").alias("cited_by_count"), t.normalize_doi(t.first_text(w["doi"], F.col("l_doi")), corpus=False).alias("doi"),
        t.first_text(w["id"], F.col("l_openalex_id")).alias("openalex_id"), F.coalesce("status", F.lit("local_only")).alias("metadata_status"),
    )


def metadata_file(rows: DataFrame) -> DataFrame:
    """METADATA as a flat file has it: lists by semicolons, affiliations as `name: a; b | name`."""
    flat = {"author_affiliations": records.affiliations_text(F.col("author_affiliations"))} | {n: F.array_join(n, "; ") for n in ("authors", "institutions", "topics")}
    return rows.select(*[flat.get(n, F.coalesce(F.col(n).cast("string"), F.lit(""))).alias(n) for n in METADATA])


def _year_parts(c: Column) -> Column:
    return F.nullif(t.date_of_parts(F.get(c["date-parts"], F.lit(0))), F.lit(""))


def mods_sources(found: DataFrame) -> dict[str, DataFrame]:
    """E5: the tables local, crossref and openalex by index, with the fields that are merged."""
    x, w = F.col("x"), F.col("w")
    first = lambda c: F.get(c, F.lit(0))
    joined = lambda c: F.nullif(F.array_join(c, "\n"), F.lit(""))
    person = lambda a: F.concat_ws(" ", F.nullif(F.trim(a["given"]), F.lit("")), F.nullif(F.trim(a["family"]), F.lit("")))
    crossref = {
        "title": first(x["title"]), "authors": joined(t.filled(F.transform(x["author"], person))), "genre": x["type"], "abstract": x["abstract"], "host_title": first(x["container-title"]),
        "date": F.coalesce(_year_parts(x["published-print"]), _year_parts(x["published-online"]), _year_parts(x["published"])),
    }
    openalex = {
        "title": w["title"], "authors": joined(_names(F.transform(w["authorships"], lambda a: a["author"]))), "genre": w["type"], "date": w["publication_date"], "abstract": t.from_inverted(w["abstract_inverted_index"], last_wins=False),
        "host_title": w["primary_location"]["source"]["display_name"],
    }
    local = {"title": F.col("l_title"), "authors": joined(F.col("l_authors")), "genre": F.col("l_work_type"), "date": F.col("l_publication_year"), "abstract": F.col("l_abstract"), "host_title": F.col("l_source_name")}
    return {name: found.select("index", *[c.alias(n) for n, c in fields.items()]) for name, fields in (("local", local), ("crossref", crossref), ("openalex", openalex))}


def mods_documents(raw: DataFrame, landing: str, folder: str, email: str = "", force: bool = False, crossref_base: str | None = None, index_base: str | None = None, **how) -> DataFrame:
    """O3: a MODS file for each record in folder, by both sources' answers merged field by field, and
    the run's manifest: index, title, doi, openalex_id, name, status (ok, failed, skipped_existing),
    crossref_status, openalex_status, error, file. Files that exist are neither asked for nor written
    again, unless forced; a record whose sources both fail has no file, and is tried again next time."""
    rows = _local(raw)
    rows = rows.withColumn("name", F.concat(remote.file_stem(F.col("index"), F.col("l_title")), F.lit(".mods.xml")))
    rows = rows.withColumn("exists", F.lit(False)) if force else remote.with_existing(rows, folder)
    urls = {"crossref": remote.crossref_url(F.col("l_doi"), **({"base": crossref_base} if crossref_base else {})), "openalex": remote.index_url(F.col("l_openalex_id"), F.col("l_doi"), email, **({"base": index_base} if index_base else {}))}
    rows = rows.withColumns({f"{k}_url": v for k, v in urls.items()})
    todo = rows.where("not exists")
    asked = todo.select(F.explode(F.array("crossref_url", "openalex_url")).alias("url"))
    answers = remote.fetch(asked.select(F.col("url").alias("key"), "url"), landing, **how)
    message = F.from_json("raw", f"message struct<{CROSSREF}>")["message"]
    parsed = {"crossref": ("x", F.coalesce(message, F.from_json("raw", CROSSREF)), "missing_doi"), "openalex": ("w", F.from_json("raw", INDEX), "missing_openalex_ref")}
    found = rows
    for source, (column, value, missing) in parsed.items():
        own = answers.select(F.col("key").alias(f"{source}_url"), F.col("status").alias(f"{source}_status"), F.when(F.col("status") == "ok", value).alias(column))
        found = found.join(own, f"{source}_url", "left").withColumn(f"{source}_status", F.coalesce(f"{source}_status", F.when(F.col("exists"), F.lit("")).otherwise(F.lit(missing))))

    merged = enrich.merge_sources(mods_sources(found), "index")
    x, w = F.col("x"), F.col("w")
    fields = {
        "subtitle": F.get(x["subtitle"], F.lit(0)), "publisher": x["publisher"], "issn": x["ISSN"], "isbn": x["ISBN"], "volume": t.first_text(x["volume"], w["biblio"]["volume"]), "issue": t.first_text(x["issue"], w["biblio"]["issue"]),
        "page": F.coalesce(F.nullif(F.trim(x["page"]), F.lit("")), F.concat_ws("-", F.nullif(w["biblio"]["first_page"], F.lit("")), F.nullif(w["biblio"]["last_page"], F.lit("")))),
        "doi": t.normalize_doi(t.first_text(x["DOI"], w["doi"], F.col("l_doi")), corpus=False), "openalex_id": t.first_text(w["id"], F.col("l_openalex_id")),
        "topics": t.distinct_ci(F.concat(F.col("l_concepts"), _names(w["concepts"]), _names(w["keywords"]))),
        "urls": F.array_distinct(t.filled(F.array(*[F.coalesce(c, F.lit("")) for c in (F.col("l_landing_page_url"), F.col("l_oa_url"), F.col("l_pdf_url"), w["primary_location"]["landing_page_url"], w["best_oa_location"]["pdf_url"])]))),
    }
    document = found.join(merged.withColumnsRenamed({"authors": "m_authors", "host_title": "source_name", "genre": "work_type", "abstract": "m_abstract"}), "index").withColumns(fields)
    document = document.withColumns({"authors": F.filter(F.split(F.coalesce("m_authors", F.lit("")), "\n"), lambda a: a != ""), "year": F.lit(None).cast("string"), "abstract": F.nullif(t.strip_tags(F.col("m_abstract")), F.lit(""))})
    ok = (F.col("crossref_status") == "ok") | (F.col("openalex_status") == "ok")
    status = F.when(F.col("exists"), "skipped_existing").when(ok, "ok").otherwise("failed")
    error = F.when(status == "failed", F.concat(F.lit("crossref="), "crossref_status", F.lit("; openalex="), "openalex_status")).otherwise(F.lit(""))
    out = document.select(
        "index", F.col("l_title").alias("title"), F.col("l_doi").alias("doi"), F.col("l_openalex_id").alias("openalex_id"), "name", status.alias("status"), "crossref_status", "openalex_status", error.alias("error"),
        F.when(status == "ok", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), records.mods(document))).alias("text"),
    )
    return remote.write_files(out, folder)
