"""What keeps the figures of a task from growing with the input, on small tables."""

import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from bibspark.operators import classify, graph
from bibspark.plans import queries, works
from bibspark.sources import scans

DATA = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_orders_are_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(works, "LINES_BYTES", 2000)
    df = works.works(spark, DATA, "work_id", "authors")
    assert int(re.search(r"RepartitionByExpression \[l_orderkey#\d+L\], (\d+)", plan(df))[1]) > 8


def test_manuscripts_are_dealt_by_size(spark, monkeypatch):
    monkeypatch.setattr(queries, "PARTS_BYTES", 50)
    assert int(re.search(r"RepartitionByExpression \[p_partkey#\d+L\], (\d+)", plan(queries.document_report(spark, DATA)))[1]) > 8


def test_rules_are_not_repeated_in_a_filter(spark):
    assert plan(queries.manual_review_queue(spark, DATA)).count("RLIKE") <= plan(queries.classify_primary(spark, DATA)).count("RLIKE")
    evidence = plan(queries.topic_evidence(spark, DATA))
    assert not re.search(r"Filter.*RLIKE", evidence)


def test_shortest_pattern_occurs_in_the_same_texts():
    assert classify.shortest("[a-c.]+@[a-c.]+") == "[a-c.]@[a-c.]" and classify.shortest("[ab]++b") == "[ab]++b" and classify.shortest(r"\[ab]+") == r"\[ab]+"
    draw = random.Random(1)
    for p in ("[ab]+@[ab]+", "[ab]+|c@", "c|[ab]+", "[ab]+?c", "a[bc]+d[ab]+", r"c\[ab]+"):
        for _ in range(300):
            x = "".join(draw.choices("abcd@[]", k=draw.randrange(7)))
            assert bool(re.search(p, x)) == bool(re.search(classify.shortest(p), x)), (p, x)


def test_inverted_index_stays_in_its_row(spark, tmp_path):
    rows = [(1, "a b  a\nc"), (1, "b"), (2, None), (3, ""), (4, " é é ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r) for r in queries.inverted_index_roundtrip(spark, str(tmp_path)).collect())
    assert got == [(1, "a b a c", "a b a c"), (1, "b", "b"), (2, "", ""), (3, "", ""), (4, "é é", "é é")]
    assert "Aggregate" not in plan(queries.inverted_index_roundtrip(spark, str(tmp_path)))


def test_objects_are_given_out_on_the_way():
    class Begins:
        value = {("p", 0): (False, 0, 1, True)}

    text = "[" + ",".join('{"a": "' + "x" * 1000 + '"}' for _ in range(4000)) + "]"
    pieces = text.split("}")
    n = len(pieces)
    out = list(scans._objects(Begins)([pa.RecordBatch.from_pydict({"value": pieces, "path": ["p"] * n, "block": pa.array([0] * n, pa.int64())})]))
    assert max(b.nbytes for b in out) < 2 << 20 and [s for b in out for s in b.column(2).to_pylist()] == list(range(1, 4001))


def test_forest_has_fewer_edges_than_nodes(spark, monkeypatch):
    draw = random.Random(2)
    edges = [(f"n{draw.randrange(30)}", f"n{draw.randrange(30)}") for _ in range(500)]
    batch = pa.RecordBatch.from_pydict({"src": [a for a, _ in edges], "dst": [b for _, b in edges]})
    assert sum(b.num_rows for b in graph._forest(iter([batch]))) == len({x for e in edges for x in e}) - 1
    monkeypatch.setattr(graph, "FOREST_NODES", 3)
    kept = [(r["src"], r["dst"]) for b in graph._forest(batch.slice(k, 5) for k in range(0, 500, 5)) for r in b.to_pylist()]
    roots = {x: x for e in edges for x in e}
    for a, b in kept:
        old, new = roots[a], roots[b]
        roots = {x: new if r == old else r for x, r in roots.items()}
    assert len(set(roots.values())) == 1


def test_chains_connect_what_pairs_connect(spark):
    w = spark.createDataFrame([(["b", "a", "b", "c"],), (["d"],), ([],), (None,), (["e", "f"],)], "authors array<string>")
    assert sorted(tuple(r) for r in graph.chains(w, "authors").collect()) == [("a", "c"), ("b", "a"), ("e", "f")]
    got = {r.node: r.component for r in graph.components(graph.chains(w, "authors")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "e": "e", "f": "e"}


def test_top_typed_edges_are_the_induced_ones(spark):
    w = spark.createDataFrame([("t1", 5, ["a", "b", "C"], ["x"]), ("t2", 3, ["a", "c"], ["x", "y"]), ("t1", 0, ["d"], [None]), (None, 2, ["b", "a"], [])], "t string, c long, authors array<string>, topics array<string>")
    none = F.array().cast("array<string>")
    fields = {"author": F.col("authors"), "affiliation": none, "journal": F.array("t"), "topic": F.col("topics"), "year": none}
    for k in (1, 2, 3):
        nodes = graph.top_typed(graph.evidence_nodes(w, fields, "t", "c"), k, 1)
        want = sorted(map(tuple, graph.induced(graph.evidence_edges(w, fields, "t", "c"), nodes, "id").collect()))
        df = graph.top_typed_edges(w, fields, "t", "c", k, 1)
        assert sorted(map(tuple, df.collect())) == want


def test_nodes_are_counted_by_title_first(spark):
    w = spark.createDataFrame([(1, "t1", 5, ["a", "B"]), (2, "t1", 3, ["A"]), (3, None, 0, ["b", "A", "a"])], "o long, t string, c long, authors array<string>")
    got = graph.evidence_nodes(w, {"author": F.col("authors")}, "t", "c", "o")
    assert plan(got).count("Aggregate") == 2
    rows = {r.id: (r.label, r.occurrences, r.citations, r.papers, tuple(r.first_seen)) for r in got.collect()}
    assert rows == {"author:a": ("a", 4, 8, 1, (1, 0, 0)), "author:b": ("B", 2, 5, 1, (1, 0, 1))}


def looped_edges(records, allowed):
    """(src, dst): weight, weight_raw, citations, papers, by loops over (title, citations, labels by kind)."""
    out = {}
    for t, c, labels in records:
        ids = {k: {f"{k}:{x.lower()}" for x in v if x is not None} for k, v in labels.items()}
        for a, b in allowed:
            for x in ids[a]:
                for y in ids[b]:
                    if a != b or x < y:
                        e = out.setdefault((min(x, y), max(x, y)), [0, 0, [], set()])
                        times = 2 if a == b else 1
                        e[0], e[1], e[2], e[3] = e[0] + times, e[1] + 1, e[2] + ([] if c is None else [c * times]), e[3] | {t} - {None}
    return sorted((*k, w, n, sum(c) if c else None, len(p)) for k, (w, n, c, p) in out.items())


def test_edges_are_added_up_where_their_node_is(spark, monkeypatch):
    draw = random.Random(3)
    pick = lambda names, n: [draw.choice([*names, None]) for _ in range(draw.randrange(n))]
    records = [(draw.choice(["t1", "t2", "T2", "", None]), draw.choice([0, 5, -2, None]), {"author": pick([f"{x}{k}" for x in ("a", "A", "\x01") for k in range(9)], 7), "topic": pick("xyz", 4), "year": pick(["1999"], 2)}) for _ in range(300)]
    records += [(None, None, {"author": ["z1", "Z2"], "topic": [], "year": []})]
    df = spark.createDataFrame([(t, c, f["author"], f["topic"], f["year"]) for t, c, f in records], "t string, c long, author array<string>, topic array<string>, year array<string>").repartition(3)
    fields = {k: F.col(k) for k in ("author", "topic", "year")}
    pairs = (("author", "author"), ("author", "topic"), ("author", "year"), ("topic", "year"), ("year", "author"))
    for often, tasks, exchanges in ((0, 1, 0), (2, 10, None), (1 << 14, 100, 1)):
        monkeypatch.setattr(graph, "OFTEN", often)
        monkeypatch.setattr(graph, "TASK_PAIRS", tasks)
        got = graph.evidence_edges(df, fields, "t", "c", pairs)
        assert sorted(map(tuple, got.select("src", "dst", "weight", "weight_raw", "citations", "papers").collect()), key=lambda r: r[:2]) == looped_edges(records, pairs)
        if exchanges:  # a node's labels go out once, and no pairs after them
            assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == exchanges
