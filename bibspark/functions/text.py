"""Scalar normalisation: every function maps Columns to a Column with JVM built-ins; the exception
is full HTML unescaping, one Arrow UDF that only texts with an ampersand reach."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# fixed values: labels that stand for a missing value, compared after trim and lower
PLACEHOLDERS = ("", "-", "--", "n/a", "na", "none", "null", "unknown")
PLACEHOLDERS_TEMPORAL = (*PLACEHOLDERS, "unknown topic")
PLACEHOLDERS_COLLABORATION = (*PLACEHOLDERS, "unknown institution", "unknown country")
PLACEHOLDERS_BIBLIOMETRIC = (*PLACEHOLDERS, "unknown source", "unknown year")
#: A character reference with its semicolon.
REFERENCE = re.compile("&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


def trim_all(x: Column) -> Column:
    """Strips Unicode white space at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    return trim_all(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def _unescape(x: pd.Series) -> pd.Series:
    return x.map(html.unescape, na_action="ignore")


def _closed(m: re.Match) -> str:
    return html.unescape(m[0]) if m[0][1] == "#" or m[0][1:] in html5 else m[0]


@F.pandas_udf(T.StringType())
def _unescape_closed(x: pd.Series) -> pd.Series:
    return x.map(lambda s: REFERENCE.sub(_closed, s), na_action="ignore")


def unescape(x: Column, closed: bool = False) -> Column:
    """All HTML5 entities; closed: only those with their semicolon, so that a reference that was cut
    off stays as it is. Python sees only texts with an ampersand, NULL in place of others."""
    return F.coalesce((_unescape_closed if closed else _unescape)(F.when(F.contains(x, F.lit("&")), x)), x)


def normalize_space(x: Column, closed: bool = False) -> Column:
    """Entities as characters, white space collapsed. NULL gives the empty string."""
    return collapse(unescape(x, closed))


def normalize_title(x: Column) -> Column:
    """N1 in lower case, each run of other than a-z and 0-9 one space."""
    return F.trim(F.regexp_replace(F.lower(normalize_space(x)), "[^a-z0-9]+", " "))


def normalize_doi(x: Column, corpus: bool = True) -> Column:
    """The corpus form is lower case; the other keeps case and drops a doi: prefix too."""
    bare = F.regexp_replace(trim_all(F.coalesce(x, F.lit(""))), r"(?i)^https?://(dx\.)?doi\.org/", "")
    return F.lower(bare) if corpus else trim_all(F.regexp_replace(bare, "(?i)^doi:", ""))


def filled(items: Column) -> Column:
    return F.filter(F.transform(items, trim_all), lambda s: s != "")


def split_any(x: Column) -> Column:
    """On ; | and newline alike, without distinct."""
    return filled(F.split(F.coalesce(x, F.lit("")), "[;|\n]"))


def split_semicolon(x: Column) -> Column:
    """N4c."""
    return filled(F.split(F.coalesce(x, F.lit("")), ";"))


def let(x: Column, body) -> Column:
    """body(x) with x computed once, however often body uses it."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def distinct_ci(items: Column) -> Column:
    """The first spelling of each, in order."""
    def of(own: Column, low: Column) -> Column:
        kept = F.filter(F.transform(own, lambda s, i: F.struct(s.alias("s"), i.alias("i"))), lambda e: F.array_position(low, F.lower(e["s"])) == e["i"] + 1)
        return F.when(F.size(F.array_distinct(low)) == F.size(low), own).otherwise(F.transform(kept, lambda e: e["s"]))

    return let(items, lambda own: let(F.transform(own, lambda s: F.lower(s)), lambda low: of(own, low)))


def named(items: Column, placeholders=PLACEHOLDERS) -> Column:
    return F.filter(items, lambda s: ~F.lower(s).isin(*placeholders))


def split_priority(x: Column, placeholders=PLACEHOLDERS) -> Column:
    """By the first delimiter kind present of ; then | then newline; placeholders dropped;
    case-insensitive distinct."""
    x = F.coalesce(x, F.lit(""))
    parts = F.when(F.contains(x, F.lit(";")), F.split(x, ";")).when(F.contains(x, F.lit("|")), F.split(x, r"\|")).otherwise(F.split(x, "\n"))
    return distinct_ci(named(filled(parts), placeholders))


def split_pipe(x: Column) -> Column:
    """N4d: | counts as ;."""
    return distinct_ci(named(split_semicolon(F.translate(x, "|", ";"))))


def label_or_empty(x: Column, placeholders=PLACEHOLDERS) -> Column:
    """N6."""
    t = trim_all(F.coalesce(x, F.lit("")))
    return F.when(F.lower(t).isin(*placeholders), F.lit("")).otherwise(t)


def parse_year(x: Column) -> Column:
    """NULL outside 1000 .. 3000 or if not a number."""
    y = x.try_cast("double")
    return F.when((y >= 1000) & (y < 3001), y.cast("int"))


def integer(x: Column, default: int = 0) -> Column:
    """N7b."""
    y = x.try_cast("double")
    return F.coalesce(F.when(F.abs(y) < 2147483648, y.cast("int")), F.lit(default))


def parse_citations(x: Column) -> Column:
    """N8."""
    return F.greatest(F.lit(0.0), F.coalesce(F.replace(x, F.lit(","), F.lit("")).try_cast("double"), F.lit(0.0)))


def inverted(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key and index, a map from the words of each row's text (parted by single spaces) to their
    positions. A row's words never leave its task."""
    def run(batches):
        for batch in (b.slice(at, 128) for b in batches for at in range(0, b.num_rows, 128)):
            words, ends, positions, cuts = [], [0], [], [0]
            for x in batch.column(1).to_pylist():
                places: dict[str, list[int]] = {}
                for p, w in enumerate(x.split(" ")):
                    places.setdefault(w, []).append(p)
                words.extend(places)
                ends.append(len(words))
                for own in places.values():
                    positions.extend(own)
                    cuts.append(len(positions))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(positions, pa.int32()))
            index = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(words, pa.string()), lists)
            yield pa.RecordBatch.from_arrays([batch.column(0), index], [key, "index"])

    return df.select(key, text).mapInArrow(run, T.StructType([df.schema[key], T.StructField("index", T.MapType(T.StringType(), T.ArrayType(T.IntegerType())))]))


def from_inverted(index: Column, last_wins: bool = True) -> Column:
    """Map word -> positions. The corpus form keeps the last word of a position and drops
    negative ones; the other keeps all words in (position, word) order."""
    pairs = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    if not last_wins:
        return F.array_join(F.transform(F.array_sort(pairs), lambda e: e["w"]), " ")
    ordered = F.array_sort(F.transform(pairs, lambda e, i: F.struct(e["p"].alias("p"), i.alias("i"), e["w"].alias("w"))))
    # each beside the one after it: the last of a position stands before another position or the end
    beside = F.zip_with(ordered, F.slice(ordered, F.lit(2), F.greatest(F.lit(0), F.size(ordered) - 1)), lambda e, after: F.struct(e["p"].alias("p"), e["w"].alias("w"), after["p"].alias("after")))
    kept = F.filter(beside, lambda e: (e["p"] >= 0) & (e["after"].isNull() | (e["after"] != e["p"])))
    return collapse(F.array_join(F.transform(kept, lambda e: e["w"]), " "))


def first_text(*columns: Column) -> Column:
    """N16."""
    return F.coalesce(*[F.nullif(trim_all(c), F.lit("")) for c in columns])


def date_of_parts(parts: Column) -> Column:
    """array<int> -> Y, Y-MM or Y-MM-DD."""
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p.cast("string")).otherwise(F.lpad(p.cast("string"), 2, "0"))), "-")


def is_w3c_date(x: Column) -> Column:
    return x.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$")


def page_range(x: Column) -> Column:
    """struct(first, last)."""
    parts = F.split(F.coalesce(x, F.lit("")), "-", 2)
    return F.struct(F.trim(parts[0]).alias("first"), F.trim(F.get(parts, F.lit(1))).alias("last"))


def strip_tags(x: Column) -> Column:
    """N19."""
    return trim_all(F.regexp_replace(F.coalesce(x, F.lit("")), "<[^>]+>", ""))


def safe_stem(ordinal: Column, x: Column, width: int = 90) -> Column:
    """NNN_slug."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.concat(F.lpad(ordinal.cast("string"), 3, "0"), F.lit("_"), F.regexp_replace(F.substring(slug, 1, width), "_+$", ""))


def shorten(x: Column, width: int = 58) -> Column:
    return F.when(F.length(x) <= width, x).otherwise(F.concat(F.rtrim(F.substring(x, 1, width - 3)), F.lit("...")))


def stable_hash(x: Column) -> Column:
    """The first 16 hex digits of SHA-256 as a decimal string."""
    return F.conv(F.substring(F.sha2(x, 256), 1, 16), 16, 10)


def scale(x: Column, low: Column, high: Column, out_low: float, out_high: float) -> Column:
    """Linear, clamped; the middle where the range is empty."""
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (x - low) / F.nullif(high - low, F.lit(0.0))))
    return F.coalesce(F.lit(out_low) + part * (out_high - out_low), F.lit((out_low + out_high) / 2))


def nice_ceiling(x: Column) -> Column:
    """An axis bound, the next number of two leading digits (5 at least). x: a whole number."""
    unit = F.pow(F.lit(10.0), F.greatest(F.lit(0), F.length(x.cast("long").cast("string")) - 2))
    return F.when(x <= 5, F.lit(5)).otherwise(F.ceil(x / unit) * unit).cast("long")


def marker_size(x: Column, low: Column, high: Column, least: float, most: float) -> Column:
    """An area between least and most that grows by the power 0.78 of x within low .. high (the
    least where the range is empty)."""
    part = F.coalesce((x - low) / F.nullif(high - low, F.lit(0)), F.lit(0.0))
    return F.lit(least) + F.pow(part, F.lit(0.78)) * (most - least)


def citation_band(n: Column) -> Column:
    """N26."""
    return F.when(n >= 500, "500+").when(n >= 200, "200-499").when(n >= 50, "50-199").when(n >= 1, "1-49").otherwise("0")


def first_of(*columns: Column) -> Column:
    """First alias that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def unite(*arrays: Column) -> Column:
    """Union of label arrays, first spellings in order."""
    return distinct_ci(filled(F.concat(*[F.coalesce(a, F.array().cast("array<string>")) for a in arrays])))


#: Names by which a dimension may be asked for.
DIMENSIONS = {
    "author": "authors", "authors": "authors",
    "institution": "institutions", "institutions": "institutions", "affiliation": "institutions", "affiliations": "institutions",
    "country": "countries", "countries": "countries", "nation": "countries", "nations": "countries",
}


def dimension(name: str) -> str:
    try:
        return DIMENSIONS[name.strip().lower()]
    except KeyError:
        raise ValueError(f"unknown dimension {name!r}") from None


def unroll(df: DataFrame, *columns, array: Column, key: str) -> DataFrame:
    """columns and a row for each struct of array; key names a field that is never NULL. Below an
    inner inline() the optimizer puts a filter on the array's size, which computes the array twice."""
    return df.select(*columns, F.inline_outer(array)).where(F.col(key).isNotNull())
