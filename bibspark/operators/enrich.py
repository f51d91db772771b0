"""Enrichment merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bibspark.functions.text import first_text

# fixed values: which source goes first, field by field
PRECEDENCE = {
    "title": ("crossref", "openalex", "local"),
    "authors": ("crossref", "openalex", "local"),
    "date": ("openalex", "crossref", "local"),
    "genre": ("crossref", "openalex", "local"),
    "abstract": ("local", "crossref", "openalex"),
    "host_title": ("local", "openalex", "crossref"),
}
COUNTRY_NAMES = {
    "AU": "Australia", "BD": "Bangladesh", "BR": "Brazil", "CA": "Canada", "CH": "Switzerland",
    "CN": "China", "CY": "Cyprus", "CZ": "Czech Republic", "DE": "Germany", "DK": "Denmark",
    "ES": "Spain", "FI": "Finland", "FR": "France", "GB": "United Kingdom", "GR": "Greece",
    "HK": "Hong Kong", "ID": "Indonesia", "IE": "Ireland", "IN": "India", "IR": "Iran",
    "IT": "Italy", "JO": "Jordan", "JP": "Japan", "KR": "South Korea", "MA": "Morocco",
    "MO": "Macao", "MX": "Mexico", "MY": "Malaysia", "NL": "Netherlands", "NO": "Norway",
    "NZ": "New Zealand", "OM": "Oman", "PH": "Philippines", "PT": "Portugal", "QA": "Qatar",
    "RO": "Romania", "RU": "Russia", "SA": "Saudi Arabia", "SE": "Sweden", "SG": "Singapore",
    "TH": "Thailand", "TR": "Turkey", "TW": "Taiwan", "US": "United States", "ZA": "South Africa",
}


def merge_sources(sources: dict[str, DataFrame], key: str, precedence=PRECEDENCE) -> DataFrame:
    """E5: local, crossref and openalex tables -> each local key with every field's first filled
    value."""
    joined = sources["local"].alias("local")
    for name in sources:
        if name != "local":
            joined = joined.join(sources[name].alias(name), F.col(f"local.{key}") == F.col(f"{name}.{key}"), "left")
    pick = []
    for field, order in precedence.items():
        have = [F.col(f"{s}.{field}") for s in order if s in sources and field in sources[s].columns]
        if have:
            pick.append(first_text(*have).alias(field))
    return joined.select(F.col(f"local.{key}").alias(key), *pick)


def venue(source: Column, kind: Column, raw: Column) -> Column:
    """A repository's name gives way to the raw venue, cut at its volume or issue."""
    cut = F.trim(F.split(F.coalesce(raw, F.lit("")), r"(?i),\s*(?:vol|issue|no|p)\b", 2)[0])
    return F.when(kind == "repository", F.coalesce(F.nullif(cut, F.lit("")), source)).otherwise(source)


def country_names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(sorted(COUNTRY_NAMES.items()), "code string, name string")


def with_country_name(df: DataFrame, code: str) -> DataFrame:
    """An unknown code is shown as it is. The table has 45 rows."""
    names = country_names(df.sparkSession).select(F.col("code").alias("__code"), F.col("name").alias("__name"))
    joined = df.join(F.broadcast(names), F.col(code) == F.col("__code"), "left")
    return joined.withColumn("country_name", F.coalesce("__name", code)).drop("__code", "__name")


def normal_work(df: DataFrame) -> DataFrame:
    """An index record with authorships and primary_location -> flat fields."""
    from bibspark.sources.records import nested

    source = F.col("primary_location.source")
    return df.select(
        "*",
        nested("authors").alias("authors"),
        nested("institutions").alias("institutions"),
        nested("countries").alias("countries"),
        venue(source["display_name"], source["type"], F.col("primary_location.raw_source_name")).alias("source_name"),
    )
