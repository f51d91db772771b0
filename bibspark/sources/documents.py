"""Documents with the files beside them (X5, X7, X9, V5, V6, O8): a folder is scanned once, names in a
document are resolved against its own folder, and all look-ups are joins by path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CLAIM = "claim_id string, claim string, sources array<string>, evidence array<string>, confidence string"
TEXT_FILES = "*.{tex,bib,svg,json,TEX,BIB,SVG,JSON}"


def folder_of(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def resolved(folder: Column, name: Column) -> Column:
    """name as a path: below folder, or below the store's root if it is absolute, without . and .. in
    it."""
    root = F.regexp_extract(folder, "^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?", 0)
    whole = F.when(F.startswith(name, F.lit("/")), name).otherwise(F.concat(F.substr(folder, F.length(root) + 1), F.lit("/"), name))
    parts = F.filter(F.split(whole, "/"), lambda s: ~s.isin("", "."))
    none = F.array().cast("array<string>")
    up = lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s)))
    return F.concat(root, F.lit("/"), F.array_join(F.aggregate(parts, none, up), "/"))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """path, text: all files below a folder; text of .tex, .bib, .svg and .json files in UTF-8 or, if
    they are none, Latin-1, NULL of all others, whose content is not read."""
    files = lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True)
    content = F.col("content")
    text = F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))
    texts = files().option("pathGlobFilter", TEXT_FILES).load(folder).select("path", text.alias("text"))
    return files().load(folder).select("path").join(texts, "path", "left")


def manuscripts(files: DataFrame, suffix: str = ".tex") -> DataFrame:
    """doc_id (the path), base (its folder) and text of the documents in a scan."""
    return files.where(F.endswith(F.lower("path"), F.lit(suffix))).select(F.col("path").alias("doc_id"), folder_of(F.col("path")).alias("base"), "text")


def ledgers(documents: DataFrame, files: DataFrame, name: str) -> DataFrame:
    """V5: the claims of each document's ledger, a JSON list or an object with a list claims: doc_id, nth,
    fault (NULL: none) and the fields of CLAIM. A ledger that is absent or no such list, and an entry that is no
    object, give a row with a fault."""
    asked = documents.select("doc_id", resolved(F.col("base"), F.lit(name)).alias("path"))
    read = asked.join(files.select("path", "text", F.lit(True).alias("there")), "path", "left")
    entries = F.coalesce(F.from_json("text", "array<string>"), F.from_json("text", "claims array<string>")["claims"])
    rows = read.withColumn("entries", F.when(F.ltrim("text").rlike(r"^[\[{]"), entries))
    each = rows.select("doc_id", "there", F.col("entries").isNotNull().alias("listed"), F.posexplode_outer("entries").alias("nth", "entry"))
    claim = F.when(F.ltrim("entry").rlike(r"^\{"), F.from_json("entry", CLAIM))
    fault = F.when(F.col("there").isNull(), "no ledger").when(~F.col("listed"), "no list").when(F.col("nth").isNotNull() & claim.isNull(), "no object")
    return each.select("doc_id", "nth", fault.alias("fault"), claim.alias("c")).where("fault is not null or c is not null").select("doc_id", "nth", "fault", "c.*")


def figure_reports(documents: DataFrame, files: DataFrame, names: list[str]) -> DataFrame:
    """doc_id, path, passed of the named reports of each document; passed only if the report says so."""
    paths = F.explode(F.array(*[resolved(F.col("base"), F.lit(n)) for n in names]))
    read = documents.select("doc_id", paths.alias("path")).join(files.select("path", "text"), "path", "left")
    return read.select("doc_id", "path", F.coalesce(F.from_json("text", "validation struct<passed: boolean>")["validation"]["passed"], F.lit(False)).alias("passed"))
