"""Record sources and sinks (S1 - S17, E1 - E4): JSON and CSV scans with alias resolution into the
canonical schema, CSV, JSON, XML and Markdown sinks, manifests, and a replayable remote source."""

from __future__ import annotations

import json
import time
import urllib.parse
import urllib.request

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from bibspark.functions import text as t
from bibspark.sources.scans import ORDINAL, numbered, read_json_list

#: Aliases of canonical fields; the first that is filled counts, for all operators alike.
ALIASES = {
    "title": ("title", "paper_title"),
    "publication_year": ("publication_year", "year"),
    "source_name": ("source_name", "journal", "source", "publication_source"),
    "cited_by_count": ("cited_by_count", "citations", "citation_count", "cited_by"),
    "authors": ("authors",),
    "institutions": ("institutions", "affiliations", "author_units"),
    "countries": ("countries", "country", "country_codes"),
    "topics": ("primary_topic_label", "primary_topic", "topics", "keywords", "theme", "concepts", "matched_queries"),
    "abstract": ("abstract",),
    "work_type": ("work_type", "type"),
    "doi": ("doi",),
    "openalex_id": ("openalex_id", "id"),
}
LISTS = ("authors", "institutions", "countries", "topics")
# fixed value: what the search is restricted to
FILTER = "from_publication_date:2000-01-01,to_publication_date:2025-12-31,language:en,type:article"


def read_records(spark: SparkSession, path: str, strict: bool = False, ordinal: str | None = None) -> DataFrame:
    """.json (lists of objects, or objects with a list `records`, unless strict; each may be
    large), .jsonl (an object a line) or .csv with a header; entries that are no objects are dropped.
    ordinal: a column for the records' numbers, from 1, in the order of files and of entries."""
    kind = path.lower().rstrip("/").rpartition(".")[2]
    if kind == "csv":
        df = spark.read.option("header", True).option("multiLine", True).csv(path)
    elif kind == "jsonl":
        df = spark.read.json(path).drop("_corrupt_record").dropna(how="all")
    elif strict and kind != "json":
        raise ValueError(f"neither .json nor .csv: {path}")
    else:
        df = read_json_list(spark, path, strict)
    return numbered(df, ordinal) if ordinal else df.drop(ORDINAL)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """A scan of fewer bytes than one split for each core is dealt over the cores (by keys, if given,
    so that a later grouping by them needs no exchange), as its few row groups would else be the
    tasks of all that follows; a larger scan is left as it is."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores, *keys) if scan_bytes(df) < cores * split else df


def scan_bytes(df: DataFrame) -> int:
    """What Spark expects a scan to read, from its files' sizes and its columns."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def shares(df: DataFrame, size: int) -> int:
    """Into how many parts a scan's rows are to be dealt, so that a part comes from about size bytes
    of files however large the input is: a part for each core at least."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-scan_bytes(df) // size))


def _text(df: DataFrame, name: str) -> Column:
    """A field as text; arrays joined by newlines, so that labels with ; stay whole only in arrays."""
    kind = df.schema[name].dataType.typeName()
    return F.array_join(name, "\n") if kind == "array" else F.col(name).cast("string")


def _labels(df: DataFrame, name: str) -> Column:
    field = df.schema[name].dataType
    if field.typeName() == "array":
        item = field.elementType
        if item.typeName() == "struct":
            names = [n for n in ("display_name", "name") if n in item.names]
            return F.transform(name, lambda e: t.trim_all(F.coalesce(*[e[n] for n in names])))
        return t.distinct_ci(t.named(t.filled(F.col(name))))
    raw = F.col(name).cast("string")
    listed = F.from_json(raw, "array<string>")
    return F.when(F.startswith(F.trim(raw), F.lit("[")), t.distinct_ci(t.named(t.filled(listed)))).otherwise(t.split_priority(raw))


def canonical(df: DataFrame, *kept: str) -> DataFrame:
    """Kept, then the canonical fields that df's aliases give, in the order of ALIASES;
    df's other columns are dropped. Empty values are NULL, or empty arrays for lists."""
    out = [F.col(k) for k in kept]
    for name, aliases in ALIASES.items():
        have = [a for a in aliases if a in df.columns]
        if name in LISTS:
            empty = F.array().cast("array<string>")
            arrays = [_labels(df, a) for a in have]
            if "authorships" in df.columns and name != "topics":
                arrays.append(nested(name))
            value = F.coalesce(*[t.let(a, lambda v: F.when(F.size(v) > 0, v)) for a in arrays], empty)
        else:
            value = F.nullif(t.first_of(*[_text(df, a) for a in have]), F.lit("")) if have else F.lit(None).cast("string")
            if name == "publication_year":
                value = t.parse_year(value)
            elif name == "cited_by_count":
                value = t.parse_citations(value).cast("long")
            elif name == "title":
                value = t.normalize_space(value)
        out.append(value.alias(name))
    return df.select(*out)


# ---- fixed values: fields of a standard record, and columns of the flat file
STANDARD = (
    "corpus_id", "record_origin", "title", "publication_year", "work_type", "source_name", "source_type", "source_is_core", "openalex_id", "doi", "landing_page_url", "oa_url", "pdf_url", "is_oa", "oa_status",
    "is_retracted", "cited_by_count", "authors", "institutions", "countries", "authorships", "concepts", "keywords", "abstract", "coverage", "expansion_direction_code", "expansion_direction_label",
    "matched_query", "selection_score", "manual_review_reason", "classification",
)
FLAT_FILE = (
    "corpus_id", "record_origin", "title", "publication_year", "work_type", "source_name", "doi", "openalex_id", "authors", "institutions", "countries", "cited_by_count", "coverage", "primary_topic_code",
    "primary_topic_label", "secondary_topic_codes", "future_direction_codes", "classification_confidence", "in_scope", "expansion_direction_code", "expansion_direction_label", "manual_review_reason",
    "matched_query", "selection_score", "oa_url", "pdf_url",
)
# ---- end of fixed values
#: What becomes of a standard record's field; all others are text with white space collapsed.
_FLAGS = ("source_is_core", "is_oa", "is_retracted")
_LISTS = ("authors", "institutions", "countries", "concepts", "keywords")
_AS_THEY_ARE = {"authorships": "array<string>", "expansion_direction_code": "string", "expansion_direction_label": "string", "selection_score": "double"}
_OTHER_NAMES = {"publication_year": "year", "work_type": "type", "source_name": "journal"}


def standard(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """The fields of STANDARD but classification, with their defaults. ordinal: the record's
    number, from which ids are made where there are none."""
    def given(name: str) -> Column | None:
        found = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in (name, _OTHER_NAMES.get(name)) if n in df.columns]
        return F.coalesce(*found) if found else None

    def value(name: str) -> Column:
        if name in _LISTS:
            if name not in df.columns:
                return F.array().cast("array<string>")
            is_array = df.schema[name].dataType.typeName() == "array"
            return F.coalesce(t.filled(F.col(name)) if is_array else t.split_any(F.col(name)), F.array().cast("array<string>"))
        if name in _FLAGS:
            return F.coalesce(F.col(name).cast("boolean"), F.lit(False)) if name in df.columns else F.lit(False)
        if name in _AS_THEY_ARE:
            return F.col(name) if name in df.columns else F.lit(None).cast(_AS_THEY_ARE[name])
        x = given(name)
        if name == "publication_year":
            return F.lit(None).cast("int") if x is None else F.trim(x).try_cast("int")
        if name == "cited_by_count":
            return F.lit(0).cast("long") if x is None else F.coalesce(x.try_cast("long"), F.lit(0))
        if name == "doi":
            return F.lit("") if x is None else t.normalize_doi(x)
        if name == "corpus_id":
            return F.coalesce(*([x] if x is not None else []), ordinal_id(F.col(ordinal), "record"))
        if name == "coverage":
            abstract = given("abstract")
            kind = F.lit("metadata_only") if abstract is None else F.when(abstract.isNotNull(), "abstract_only").otherwise("metadata_only")
            return kind if x is None else F.coalesce(x, kind)
        default = {"record_origin": "original_150", "work_type": "article"}.get(name, "")
        return F.lit(default) if x is None else F.coalesce(F.nullif(t.normalize_space(x), F.lit("")), F.lit(default))

    return df.select(*[value(n).alias(n) for n in STANDARD[:-1]])


def flat_file(df: DataFrame) -> DataFrame:
    """The columns of FLAT_FILE of standard records with classification."""
    c = F.col("classification")
    out = {
        "work_type": F.coalesce(F.nullif(c["work_type_normalized"], F.lit("")), F.col("work_type")), "primary_topic_code": c["primary_topic_code"], "primary_topic_label": c["primary_topic_label"],
        "secondary_topic_codes": F.array_join(c["secondary_topic_codes"], "; "), "future_direction_codes": F.array_join(c["future_direction_codes"], "; "), "classification_confidence": c["confidence"], "in_scope": c["in_scope"],
    }
    out |= {n: F.array_join(n, "; ") for n in ("authors", "institutions", "countries")}
    return df.select(*[out.get(n, F.col(n)).alias(n) for n in FLAT_FILE if n in out or n in df.columns])


def section_text(df: DataFrame, name: str) -> Column:
    """A list field (an array, or text parted by ; | or line ends) as one text for rules to search."""
    if name not in df.columns:
        return F.lit("")
    if df.schema[name].dataType.typeName() == "array":  # entities are unescaped in the whole, which a lambda cannot do
        return t.normalize_space(F.array_join(t.filled(F.transform(F.col(name).cast("array<string>"), t.collapse)), " ; "))
    return F.coalesce(F.array_join(t.split_any(F.col(name).cast("string")), " ; "), F.lit(""))


def nested(dimension: str) -> Column:
    """Labels of an array authorships<author, institutions, countries>, distinct in order."""
    if dimension == "authors":
        values = F.transform("authorships", lambda a: a["author"]["display_name"])
    elif dimension == "institutions":
        values = F.flatten(F.transform("authorships", lambda a: F.transform(a["institutions"], lambda i: i["display_name"])))
    else:
        values = F.flatten(F.transform("authorships", lambda a: F.concat(a["countries"], F.transform(a["institutions"], lambda i: i["country_code"]))))
    return F.array_distinct(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""))


def required(df: DataFrame) -> DataFrame:
    """Rows with title, year, authors, source and topic."""
    return df.where("title <> '' and publication_year is not null and size(authors) > 0 and source_name <> '' and size(topics) > 0")


def merge_spec(defaults: dict, overrides: dict) -> dict:
    """One level deep; dictionaries are updated, other values replaced."""
    return defaults | {k: {**defaults[k], **v} if isinstance(v, dict) and isinstance(defaults.get(k), dict) else v for k, v in overrides.items()}


def prefix(df: DataFrame, ordinal: str, n: int) -> DataFrame:
    """The first n rows; 0 means all."""
    return df.orderBy(ordinal).limit(n) if n else df


def ordinal_id(ordinal: Column, name: str) -> Column:
    """Name-001, name-002 ..."""
    text = ordinal.cast("string")
    return F.concat(F.lit(f"{name}-"), F.when(F.length(text) < 3, F.lpad(text, 3, "0")).otherwise(text))


def sample_records(spark: SparkSession) -> DataFrame:
    """Six invented records, one a year, for trying a run without input."""
    rows = [
        (f"Study {k} of reading tutors", [f"Author, {a}.", f"Author, {b}."], "Journal of Invented Studies", 2018 + k, ["Tutoring", "Reading" if k % 2 else "Writing"], [f"University {a}"], 7 * k)
        for k, (a, b) in enumerate(("AB", "BC", "CD", "DE", "EA", "AC"), 1)
    ]
    return spark.createDataFrame(rows, "title string, authors array<string>, journal string, year int, topics array<string>, affiliations array<string>, citations int")


def flat(df: DataFrame) -> DataFrame:
    """Arrays joined by '; ', structs flattened, ready for a CSV sink."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "array":
            out.append(F.array_join(F.transform(f.name, lambda x: x.cast("string")), "; ").alias(f.name))
        elif kind == "struct":
            out += [F.col(f"{f.name}.{n}").alias(f"{f.name}_{n}") for n in f.dataType.names]
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def affiliations_text(column: Column) -> Column:
    """S9: 'name: inst; inst | name'."""
    one = lambda a: F.concat(a["name"], F.when(F.size(a["institutions"]) > 0, F.concat(F.lit(": "), F.array_join(a["institutions"], "; "))).otherwise(F.lit("")))
    return F.array_join(F.transform(column, one), " | ")


def write_csv(df: DataFrame, path: str) -> None:
    flat(df).write.option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def write_json_lists(df: DataFrame, path: str) -> None:
    """The counterpart of read_records for .json: each partition's rows as a file with one JSON list."""
    def listed(batches):
        before = "["
        for batch in batches:
            rows = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": [(before if not k else ",") + r for k, r in enumerate(rows)]})
            before = "," if rows else before
        yield pa.RecordBatch.from_pydict({"value": ["[]" if before == "[" else "]"]})

    df.select(F.to_json(F.struct("*")).alias("value")).mapInArrow(listed, "value string").write.text(path)


def mods(df: DataFrame) -> Column:
    """A MODS document for each row with title, authors, year, work_type, doi, source_name,
    abstract, topics and, where df has them, subtitle, publisher, date, openalex_id, issn, volume,
    issue, page and url."""
    def field(name: str, kind: str = "string") -> Column:
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        return F.nullif(value, F.lit("")) if kind == "string" else value

    def whole(c: Column, of: Column) -> Column:
        """of, unless c is NULL: no empty elements."""
        return F.when(c.isNotNull(), of)

    def typed(kind: str, c: Column) -> Column:
        return F.struct(F.lit(kind).alias("_type"), c.alias("_VALUE"))

    def numbered(kind: str, c: Column) -> Column:
        return whole(c, F.struct(F.lit(kind).alias("_type"), c.alias("number")))

    date = F.coalesce(field("date"), field("year"))
    issued = F.when(t.is_w3c_date(date), F.struct(F.lit("w3cdtf").alias("_encoding"), date.alias("_VALUE"))).otherwise(F.struct(F.lit(None).cast("string").alias("_encoding"), date.alias("_VALUE")))
    pages = t.page_range(field("page"))
    extent = whole(field("page"), F.struct(F.lit("pages").alias("_unit"), F.nullif(pages["first"], F.lit("")).alias("start"), F.nullif(pages["last"], F.lit("")).alias("end")))
    details = F.array_compact(F.array(numbered("volume", field("volume")), numbered("issue", field("issue"))))
    issn = field("issn", "array<string>")
    host = F.struct(
        F.lit("host").alias("_type"),
        F.struct(F.col("source_name").alias("title")).alias("titleInfo"),
        F.transform(issn, lambda x: typed("issn", x)).alias("identifier"),
        F.when((F.size(details) > 0) | extent.isNotNull(), F.struct(details.alias("detail"), extent.alias("extent"))).alias("part"),
    )
    urls = F.col("urls") if "urls" in df.columns else F.filter(F.array(field("url")), lambda x: x.isNotNull())
    name = lambda a: F.struct(F.lit("personal").alias("_type"), a.alias("namePart"), F.struct(F.struct(F.lit("text").alias("_type"), F.lit("author").alias("_VALUE")).alias("roleTerm")).alias("role"))
    return F.to_xml(
        F.struct(
            F.lit("3.7").alias("_version"),
            F.struct(F.col("title").alias("title"), field("subtitle").alias("subTitle")).alias("titleInfo"),
            F.transform("authors", name).alias("name"),
            F.struct(field("publisher").alias("publisher"), issued.alias("dateIssued")).alias("originInfo"),
            F.col("work_type").alias("genre"),
            F.concat(F.array_compact(F.array(whole(field("doi"), typed("doi", field("doi"))), whole(field("openalex_id"), typed("openalex", field("openalex_id"))))), F.coalesce(F.transform(field("isbn", "array<string>"), lambda x: typed("isbn", x)), F.array().cast("array<struct<_type:string,_VALUE:string>>"))).alias("identifier"),
            F.when(F.coalesce("source_name", F.lit("")) != "", host).alias("relatedItem"),
            F.col("abstract").alias("abstract"),
            F.transform("topics", lambda x: F.struct(x.alias("topic"))).alias("subject"),
            F.when(F.size(urls) > 0, F.struct(urls.alias("url"))).alias("location"),
        ),
        {"rowTag": "mods"},
    )


def markdown(summary: DataFrame, title: str) -> DataFrame:
    """One row, text: a table for each metric of (metric, key, n)."""
    line = F.concat(F.lit("| "), F.col("key"), F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    parts = summary.groupBy("metric").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col("key").alias("k"), line.alias("l")))).alias("rows"))
    section = F.concat(F.lit("## "), F.col("metric"), F.lit("\n\n| value | n |\n|---|---:|\n"), F.array_join(F.transform("rows", lambda r: r["l"]), "\n"))
    body = parts.agg(F.array_join(F.array_sort(F.collect_list(section)), "\n\n").alias("b"))
    return body.select(F.concat(F.lit(f"# {title}\n\n"), F.col("b"), F.lit("\n")).alias("text"))


def taxonomy_table(spark: SparkSession, rules) -> DataFrame:
    """S12."""
    return spark.createDataFrame([(r.code, r.label, r.group, list(r.patterns)) for r in rules], "code string, label string, reference_group string, patterns array<string>")


def pending(df: DataFrame, manifest: DataFrame, id_col: str, force: bool = False) -> DataFrame:
    """Rows that the manifest does not name as done."""
    return df if force else df.join(manifest.where("status in ('ok', 'skipped_existing')").select(id_col), id_col, "left_anti")


def manifest(df: DataFrame, done: DataFrame, failed: DataFrame, id_col: str) -> DataFrame:
    """Status of each record: ok, failed or skipped_existing."""
    d, f = done.select(id_col).distinct().withColumn("__d", F.lit(True)), failed.select(id_col).distinct().withColumn("__f", F.lit(True))
    status = F.when(F.col("__d"), "skipped_existing").when(F.col("__f"), "failed").otherwise("ok")
    return df.select(id_col).join(d, id_col, "left").join(f, id_col, "left").select(id_col, status.alias("status"))


# ---------------------------------------------------------------- remote records
def work_url(openalex_id: Column, doi: Column, base: str = "https://api.openalex.org/works/") -> Column:
    """By id, else by DOI; NULL without either."""
    return F.when(F.coalesce(openalex_id, F.lit("")) != "", F.concat(F.lit(base), F.url_encode(openalex_id))).when(
        F.coalesce(doi, F.lit("")) != "", F.concat(F.lit(f"{base}https%3A%2F%2Fdoi.org%2F"), F.url_encode(doi))
    )


def get_json(url: str, retries: int = 2, timeout: float = 30.0, wait=lambda attempt: 0.5 * (attempt + 1), get=None) -> tuple[dict | None, str]:
    """(data, status), never an exception; 404 ends at once. wait: seconds before the next attempt."""
    get = get or (lambda u: urllib.request.urlopen(urllib.request.Request(u, headers={"User-Agent": "bibspark"}), timeout=timeout).read())  # noqa: S310
    status = "no_attempt"
    for attempt in range(retries + 1):
        try:
            return json.loads(get(url)), "ok"
        except Exception as e:  # noqa: BLE001 - the status says what went wrong
            if getattr(e, "code", None) == 404:
                return None, "not_found"
            status = f"error: {type(e).__name__}"
            if attempt < retries:
                time.sleep(wait(attempt))
    return None, status


def crossref(doi: str, base: str = "https://api.crossref.org/works/", **options) -> tuple[dict | None, str]:
    """(message, status) of a DOI."""
    if not (doi or "").strip():
        return None, "missing_doi"
    data, status = get_json(base + urllib.parse.quote(doi, safe=""), **options)
    message = data.get("message") if isinstance(data, dict) else None
    return (message if isinstance(message, dict) else data), status


def land(answers: DataFrame, folder: str) -> None:
    """The answers (query, status, raw) as they came, before anything is parsed."""
    answers.write.mode("append").json(folder)


def replay(spark: SparkSession, folder: str) -> DataFrame:
    """Landed answers, one for each query."""
    rows = spark.read.schema("query string, status string, raw string").json(folder)
    return rows.groupBy("query").agg(F.max_by(F.struct("status", "raw"), F.struct((F.col("status") == "ok").alias("ok"), F.length("raw").alias("size"), "raw")).alias("a")).select("query", "a.*")


class SearchSource(DataSource):
    """Format "bibspark_search". Options: queries (newline-separated), per_page, filter (FILTER by
    default), rate_limit (seconds before each request), and either landing (a mounted folder of raw
    answers, one file 000.json for each query: replay) or base_url. One partition a query, three
    attempts each; rows query, status, raw. strict: an answer that fails ends the job."""

    @classmethod
    def name(cls) -> str:
        return "bibspark_search"

    def schema(self) -> str:
        return "query string, status string, raw string"

    def reader(self, schema):
        return SearchReader(self.options)


class SearchReader(DataSourceReader):
    def __init__(self, options):
        self.queries = [q for q in options.get("queries", "").split("\n") if q.strip()]
        self.landing, self.base = options.get("landing"), options.get("base_url")
        self.per_page, self.delay = options.get("per_page", "100"), float(options.get("rate_limit", "0.15"))
        self.filter, self.strict = options.get("filter", FILTER), options.get("strict", "false") == "true"

    def partitions(self):
        return [InputPartition(k) for k in range(len(self.queries))]

    def read(self, partition):
        k = partition.value
        query = self.queries[k]
        if self.landing:
            try:
                with open(f"{self.landing}/{k:03d}.json", encoding="utf-8") as f:
                    yield query, "replayed", f.read()
            except OSError:
                yield query, "missing", None
            return
        time.sleep(self.delay)
        asked = {"search": query, "filter": self.filter, "per-page": self.per_page}
        data, status = get_json(f"{self.base}?{urllib.parse.urlencode(asked)}", retries=2, timeout=45.0, wait=lambda attempt: 2.0**attempt)
        if self.strict and data is None:
            raise RuntimeError(f"search failed for {query!r}: {status}")
        yield query, status, json.dumps(data) if data else None
