"""Identity keys, anti joins, best record by key, quota selection."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Candidates that the quota selection takes to the driver at a time.
BLOCK = 1000


def dedup_keys(index_id: Column, doi: Column, title: Column) -> Column:
    """None to three keys."""
    key = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}:"), c))
    return F.array_compact(F.array(key("openalex", index_id), key("doi", doi), key("title", title)))


def anti_join_any_key(df: DataFrame, known: DataFrame, id_col: str, keys: str = "keys") -> DataFrame:
    """Rows of df none of whose keys is a key of known."""
    old = known.select(F.explode(keys).alias("key")).distinct()
    hit = df.select(id_col, F.explode(keys).alias("key")).join(old, "key", "left_semi").select(id_col).distinct()
    return df.join(hit, id_col, "left_anti")


def best_per_key(df: DataFrame, group: str, keys: str, score: str, arrival: str, title: str) -> DataFrame:
    """D3: the best of each canonical key (the least; without keys the title's SHA-1) in a group,
    the first on ties; first_seen is the arrival of the key's first record. One row a key is kept
    before the exchange already."""
    canonical = F.coalesce(F.array_min(keys), F.concat(F.lit("sha1:"), F.sha1(title)))
    rows = df.withColumn("canonical", canonical)
    best = rows.groupBy(group, "canonical").agg(F.min_by(F.struct(*df.columns), F.struct((-F.col(score)).alias("s"), F.col(arrival).alias("a"))).alias("best"), F.min(arrival).alias("first_seen"))
    return best.select("best.*", "canonical", "first_seen")


def quota_selection(df: DataFrame, quotas: list[tuple[str, int]], group: str, id_col: str, keys: str, order: list[Column]) -> DataFrame:
    """Groups in the given order take their best records until the quota, skipping those one of
    whose keys is taken. What is taken depends on all before, so the driver walks each group's
    ranked records, a block at a time: the next block leaves out all that the keys taken so far
    exclude, so its first record is always taken and the walk ends with the quota or the group.
    Returns group, nth, id_col."""
    wanted = df.where(F.col(group).isin([g for g, _ in quotas])).withColumn("__id", F.col(id_col)).persist()
    taken: set[str] = set()
    out = []
    for g, quota in quotas:
        n = keyless = 0  # records without keys that were taken come first again
        while n < quota:
            left = wanted.where(F.col(group) == g)
            if taken:
                known = F.from_json(F.lit(json.dumps(sorted(taken))), "array<string>")
                left = left.where(~F.coalesce(F.arrays_overlap(F.col(keys), known), F.lit(False)))
            rows = left.orderBy(*order, "__id").select("__id", keys).limit(keyless + BLOCK).collect()[keyless:]
            if not rows:
                break
            for r in rows:
                if n == quota:
                    break
                own = [k for k in r[keys] or [] if k is not None]
                if taken.isdisjoint(own):
                    taken.update(own)
                    keyless += not own
                    n += 1
                    out.append((g, n, r["__id"]))
    wanted.unpersist()
    kind = df.schema[id_col].dataType.simpleString()
    return df.sparkSession.createDataFrame(out, f"`{group}` string, nth int, `{id_col}` {kind}")


def taken(picked: DataFrame, quotas: list[tuple[str, int]], group: str) -> list[tuple[str, int]]:
    """How many records each group gave, in the order of quotas."""
    n = {r[0]: r[1] for r in picked.groupBy(group).agg(F.count("*")).collect()}
    return [(g, n.get(g, 0)) for g, _ in quotas]


def incremental_duplicates(df: DataFrame, ordinal: str, keys: str = "keys") -> DataFrame:
    """Df with is_duplicate: some key was seen in an earlier row."""
    exploded = df.select(ordinal, F.explode(keys).alias("key"))
    first = exploded.groupBy("key").agg(F.min(ordinal).alias("first"))
    hit = exploded.join(first, "key").where(F.col("first") < F.col(ordinal)).select(ordinal).distinct().withColumn("is_duplicate", F.lit(True))
    return df.join(hit, ordinal, "left").withColumn("is_duplicate", F.coalesce("is_duplicate", F.lit(False)))


def merge_corpora(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer join on the key; a new value goes before an old one."""
    names = [c for c in old.columns if c != key]
    o, n = old.alias("o"), new.alias("n")
    pick = [F.coalesce(f"n.{c}", f"o.{c}").alias(c) if c in new.columns else F.col(f"o.{c}") for c in names]
    return o.join(n, key, "full").select(key, *pick)


def look_up(df: DataFrame, known: DataFrame, key: str, missing: dict) -> DataFrame:
    """Df with known's columns by key; missing gives the value of each where there is none."""
    named = df.join(known.select(key, *missing), key, "left")
    return named.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in missing.items()})


def union(first: DataFrame, second: DataFrame) -> DataFrame:
    """D6."""
    return first.unionByName(second, allowMissingColumns=True)
