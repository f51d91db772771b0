"""Registered queries that do the whole job, against plain loops on small tables."""

from pyspark.sql import functions as F

from bibspark.operators import dedup
from bibspark.plans import queries

WORK = "work_id long, authors array<string>"


def test_components_keep_weak_edges(spark, monkeypatch):
    parties = [["a", "b"]] * 3 + [["b", "c"], ["d", "e"], ["e", "f"], ["g"], [], ["k", "j"], ["j", "m", "n"]]
    w = spark.createDataFrame(list(enumerate(parties)), WORK)
    monkeypatch.setattr(queries, "works", lambda s, d, *_: w)
    near: dict[str, set] = {}
    for p in parties:
        for x in p:
            near.setdefault(x, set()).update(y for y in p if y != x)
    want = {}
    for x in (x for x in near if near[x]):
        seen, todo = {x}, [x]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        want[x] = min(seen)
    got = {r.node: r.component for r in queries.collab_components(spark, "").collect()}
    assert got == want and len(got) == 10


def greedy(rows, quotas):
    taken, out = set(), []
    for g, quota in quotas:
        n = 0
        for r in rows:
            if r[0] == g and n < quota and taken.isdisjoint(r[2] or []):
                taken.update(r[2] or [])
                n += 1
                out.append((g, n, r[1]))
    return out


def test_quota_walks_past_a_block(spark, monkeypatch):
    rows = [("A", k, ["hot"] if k % 2 else ["hot", f"k{k}"], -k) for k in range(40)] + [("A", 40, [], -40), ("A", 41, None, -41), ("A", 42, ["x"], -42), ("B", 43, ["x"], 0), ("B", 44, ["y"], -1)]
    df = spark.createDataFrame(rows, "g string, id long, keys array<string>, s int")
    quotas = [("A", 4), ("B", 3)]
    for block in (1, 3, 1000):
        monkeypatch.setattr(dedup, "BLOCK", block, raising=False)
        got = dedup.quota_selection(df, quotas, "g", "id", "keys", [F.desc("s")]).collect()
        assert [tuple(r) for r in got] == greedy(rows, quotas)


def test_quota_query_has_no_row_cap(spark, monkeypatch):
    """120 copies of one key stand before the works that fill the quota."""
    rows = [("MACHINERY", k, ["hot"], "t", 500 - k) for k in range(120)] + [("MACHINERY", 200 + k, [f"k{k}"], "t", 1) for k in range(15)]
    monkeypatch.setattr(queries, "_keyed", lambda s, d, *_: spark.createDataFrame(rows, "source_name string, work_id long, keys array<string>, title string, citations long"))
    got = [(r.source_name, r.nth, r.work_id) for r in queries.quota_selection(spark, "").collect()]
    assert got == greedy(rows, [("MACHINERY", 10)]) and len(got) == 10
