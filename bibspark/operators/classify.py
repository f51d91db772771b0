"""Rule classification (C2 - C10). A taxonomy compiles to one score column a rule; all of it is a
projection without any shuffle."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibspark.functions.text import collapse, unroll
from bibspark.operators import taxonomy as t


#: A class repeated once or more, as the first and as the last thing of a pattern.
LEADING, TRAILING = re.compile(r"^(\[[^\[\]\\&]+\])\+(?![+?])"), re.compile(r"(?<![\\\[])(\[[^\[\]\\&]+\])\+$")


def shortest(pattern: str) -> str:
    """A pattern that occurs in the same texts: at its ends one of a class says what many of it say,
    and a text without a match is not run through once more from each place of such a run."""
    return TRAILING.sub(r"\1", LEADING.sub(r"\1", pattern))


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(f"(?iU){shortest(pattern)}")


def _total(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms, F.lit(0.0))


def score(rule: t.Rule, sections: dict[str, Column], weights=t.WEIGHTS) -> Column:
    """Each (pattern, section) that matches adds the section's weight, once."""
    return _total([F.when(matches(s, p), F.lit(weights[k])).otherwise(F.lit(0.0)) for p in rule.patterns for k, s in sections.items()])


def matched_evidence(sections: dict[str, Column], rules=t.EDUCATION_RULES) -> Column:
    """A map from the codes of the rules that match to where they do: section:text of the first
    match of each pattern in each section (white space collapsed, 100 characters at most), pattern by
    pattern, each once."""
    def found(rule: t.Rule) -> Column:
        one = lambda p, k, s: F.when(matches(s, p), F.concat(F.lit(f"{k}:"), F.substring(collapse(F.regexp_extract(s, f"(?iU){p}", 0)), 1, 100)))
        return F.array_distinct(F.array_compact(F.array(*[one(p, k, s) for p in rule.patterns for k, s in sections.items()])))

    return F.map_filter(F.create_map(*[x for r in rules for x in (F.lit(r.code), found(r))]), lambda _, v: F.size(v) > 0)


def with_scores(df: DataFrame, rules=t.EDUCATION_RULES, sections: dict[str, Column] | None = None, weights=t.WEIGHTS) -> DataFrame:
    """df with ranked: array of (code, score) of the rules that match, best first, ties by code.
    The scores are columns of their own first, so that each is computed once."""
    sections = sections or {k: F.coalesce(F.col(k), F.lit("")) for k in weights if k in df.columns}
    scored = df.withColumns({f"__{r.code}": score(r, sections, weights) for r in rules})
    every = F.array(*[F.struct((-F.col(f"__{r.code}")).alias("neg"), F.lit(r.code).alias("code")) for r in rules])
    ranked = F.transform(F.array_sort(F.filter(every, lambda e: e["neg"] < 0)), lambda e: F.struct(e["code"].alias("code"), (-e["neg"]).alias("score")))
    return scored.withColumn("ranked", ranked).drop(*[f"__{r.code}" for r in rules])


def classify(df: DataFrame, rules=t.EDUCATION_RULES, sections=None, weights=t.WEIGHTS, scope: tuple[str, str] = (t.EDUCATION, t.AI), scope_text: Column | None = None) -> DataFrame:
    """Df with ranked, in_scope, primary_code, secondary_codes, confidence."""
    df = with_scores(df, rules, sections, weights)
    if scope_text is None:
        scope_text = F.concat_ws(" ", *[F.col(k) for k in ("title", "abstract", "concepts") if k in df.columns])
    top = F.coalesce(F.get("ranked", F.lit(0))["score"], F.lit(0.0))
    second = F.coalesce(F.get("ranked", F.lit(1))["score"], F.lit(0.0))
    df = df.withColumns({"education_signal": matches(scope_text, scope[0]), "ai_signal": matches(scope_text, scope[1])})
    df = df.withColumn("in_scope", F.col("education_signal") & (F.col("ai_signal") | (top >= 5.0)))
    ruled = F.col("in_scope") & (top >= 3.0)
    codes = lambda low, rest: F.slice(F.transform(F.filter(rest, lambda e: e["score"] >= low), lambda e: e["code"]), 1, 4)
    return df.withColumns(
        {
            "primary_code": F.when(~F.col("in_scope"), t.EXCLUDED.code).when(ruled, F.get("ranked", F.lit(0))["code"]).otherwise(t.FALLBACK.code),
            "secondary_codes": F.when(~F.col("in_scope"), F.array().cast("array<string>")).when(ruled, codes(2.5, F.slice("ranked", 2, 1000))).otherwise(codes(1.0, F.col("ranked"))),
            "confidence": F.when(~F.col("in_scope"), F.when(F.col("education_signal"), "medium").otherwise("high"))
            .when(ruled & (top >= 8.0) & (top - second >= 2.5), "high")
            .when(ruled & (top >= 4.0), "medium")
            .otherwise("low"),
        }
    )


def work_type(given: Column, text: Column, pattern: str = t.REVIEW) -> Column:
    """C4."""
    return F.when(matches(text, pattern), "review").otherwise(F.coalesce(F.nullif(F.trim(given), F.lit("")), F.lit("article")))


def directions(text: Column, rules=t.EDUCATION_DIRECTIONS) -> Column:
    """Codes of the directions all of whose patterns match."""
    return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a & b, [matches(text, p) for p in d.patterns]), d.code) for d in rules]))


def direction_score(d: t.Direction, body: Column, title: Column, primary: Column, cites: Column, core: Column, has_doi: Column, has_abstract: Column, has_institutions: Column, is_reference: Column) -> Column:
    """C6; -1 where the record does not fit."""
    fits = reduce(lambda a, b: a & b, [*[matches(body, p) for p in d.patterns], *[matches(title, p) for p in d.title_patterns], primary.isin(*d.allowed) if d.allowed else F.lit(True)])
    bonus = lambda c, n: F.when(c, F.lit(float(n))).otherwise(F.lit(0.0))
    hits = _total([bonus(matches(title, p), 8) for p in d.patterns])
    value = F.lit(20.0) + hits + F.least(F.lit(12.0), F.lit(4.0) * F.log10(cites + 1)) + bonus(core, 8) + bonus(has_doi, 2) + bonus(has_abstract, 2) + bonus(has_institutions, 2) + bonus(is_reference, 100)
    return F.when(fits, value).otherwise(F.lit(-1.0))


def coverage(full_text: Column, abstract: Column) -> Column:
    """C7."""
    return F.when(full_text, "full_text_local").when(abstract, "abstract_only").otherwise("metadata_only")


def review_queue(classified: DataFrame) -> DataFrame:
    """What a person should look at, and why."""
    reason = F.when(~F.col("in_scope"), "out_of_scope").when(F.col("confidence") == "low", "low_confidence")
    # a filter right above the reason would be pushed below the classification and repeat it there
    return unroll(classified, "*", array=F.array(F.struct(reason.alias("reason"))), key="reason")


def is_review(title: Column, kind: Column, terms=t.REVIEW_TERMS) -> Column:
    """By substring of title and type; not the definition of C4."""
    return F.lower(F.concat_ws(" ", title, kind)).rlike("|".join(terms))


def reject_reason(checks: list[tuple[str, Column]]) -> Column:
    """The first check that holds, in the given order; NULL if accepted."""
    return reduce(lambda c, k: c.when(k[1], k[0]), checks[1:], F.when(checks[0][1], checks[0][0]))


def retrieve(text: Column, groups: list[list[str]]) -> Column:
    """Some term of every group occurs; * is a word's rest."""
    def one(term: str) -> str:
        return r"\b" + term.replace("*", r"\w*") + r"\b"

    return reduce(lambda a, b: a & b, [matches(text, "(?:" + "|".join(map(one, g)) + ")") for g in groups])
