"""Semantics of single operators on small fixtures."""

import json

import pytest
from pyspark.sql import functions as F

from bibspark.functions import text as t
from bibspark.operators import classify, dedup, gates, graph, textgate
from bibspark.operators.taxonomy import EDUCATION_DIRECTIONS, EDUCATION_RULES, WEIGHTS
from bibspark.sources import records


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(
    ("title", "abstract", "code"),
    [
        ("Machine learning for cancer prognosis", "We predict survival.", "X00"),
        ("Artificial intelligence in education: an overview", "A field overview.", "O01"),
        ("ChatGPT in higher education", "Students use a large language model.", "E01"),
        ("An intelligent tutoring system for autistic learners", "Special education.", "T16"),
    ],
)
def test_classification(spark, title, abstract, code):
    df = spark.createDataFrame([(title, abstract)], "title string, abstract string")
    assert classify.classify(df, EDUCATION_RULES, weights=WEIGHTS).first()["primary_code"] == code


def test_rules_are_complete():
    assert (len(EDUCATION_RULES), sum(len(r.patterns) for r in EDUCATION_RULES), len(EDUCATION_DIRECTIONS)) == (19, 112, 9)


def test_normalisation(spark):
    r = one(
        spark,
        t.normalize_title(F.lit(" Deep  &amp; Wide! ")).alias("a"), t.normalize_doi(F.lit("https://doi.org/10.1/AB")).alias("b"), t.normalize_doi(F.lit("doi:10.1/AB"), corpus=False).alias("c"),
        t.split_priority(F.lit("AI|x; ai ;n/a; Y")).alias("d"), t.distinct_ci(F.array(*map(F.lit, ["AI", "x", "ai", "X", "y"]))).alias("e"), t.parse_year(F.lit("2019.7")).alias("f"), t.parse_year(F.lit("99")).alias("g"),
        t.from_inverted(F.expr("map('b', array(1), 'a', array(0, 2))")).alias("h"), t.page_range(F.lit("12-34")).alias("i"), t.date_of_parts(F.array(F.lit(2020), F.lit(3))).alias("j"), t.normalize_space(F.lit("a&nbsp;b &eacute;")).alias("k"),
    )
    assert r["a"] == "deep wide" and r["b"] == "10.1/ab" and r["c"] == "10.1/AB"
    assert r["d"] == ["AI|x", "ai", "Y"] and r["e"] == ["AI", "x", "y"]
    assert r["f"] == 2019 and r["g"] is None and r["h"] == "a b a" and tuple(r["i"]) == ("12", "34") and r["j"] == "2020-03" and r["k"] == "a b é"


def test_collaboration(spark):
    works = spark.createDataFrame([(["US", "CA"],), (["US", "GB"],), (["CA", "GB"],), (["US", "CA"],), ([],)], "v array<string>")
    edges = {(r.src, r.dst): r.weight for r in graph.collaboration_edges(works, "v").collect()}
    assert edges == {("CA", "US"): 2, ("GB", "US"): 1, ("CA", "GB"): 1}


def test_components_and_communities(spark):
    chain = spark.createDataFrame([(f"n{k:02d}", f"n{k + 1:02d}", 1) for k in range(12)] + [("x", "y", 1)], "src string, dst string, weight int")
    assert {r.component for r in graph.components(chain).collect()} == {"n00", "x"}
    links = {("a", "b"): 1.0, ("b", "c"): 1.0, ("a", "c"): 1.0, ("d", "e"): 1.0, ("e", "f"): 1.0, ("d", "f"): 1.0, ("c", "d"): 1.0}
    assert sorted(map(sorted, graph.greedy_modularity(list("abcdef"), links))) == [["a", "b", "c"], ["d", "e", "f"]]


def test_quota(spark):
    rows = [("A", 1, ["k1"], 9), ("A", 2, ["k2"], 8), ("B", 3, ["k1", "k3"], 9), ("B", 4, ["k4"], 1)]
    df = spark.createDataFrame(rows, "g string, id long, keys array<string>, s int")
    got = dedup.quota_selection(df, [("A", 1), ("B", 2)], "g", "id", "keys", [F.desc("s"), F.col("id")]).collect()
    assert [(r.g, r.nth, r.id) for r in got] == [("A", 1, 1), ("B", 1, 4)]


def test_text_gate(spark):
    text = "\\section{Introduction}\nfoo \\cite{a,b} % \\cite{c}\n50\\% kept\n\\begin{figure}\\caption{x}\\end{figure}\nTODO\n\\keywords{x}"
    r = one(spark, F.lit(text).alias("x")).x
    df = spark.createDataFrame([(r,)], "x string")
    x = F.col("x")
    got = df.select(textgate.strip_comments(x).alias("s"), textgate.citation_keys(textgate.strip_comments(x)).alias("k"), textgate.float_defects(x).alias("f")).first()
    assert "50\\% kept" in got.s and got.k == ["a", "b"] and got.f == 1
    known = spark.createDataFrame([(1, "a")], "doc_id int, key string")
    report = textgate.document_report(df.select(F.lit(1).alias("doc_id"), F.col("x").alias("text")), known, min_words=1000).first()
    kinds = {e.partition(":")[0] for e in report.errors}
    assert {"section", "too_few_words", "caption_or_label", "leak"} <= kinds and "citation: b" in report.errors and "keywords" not in kinds


def test_flow_gate(spark):
    nodes = spark.createDataFrame([("a", "stage", 10), ("b", "stage", 7), ("c", "side", 3)], "id string, kind string, n int")
    good = spark.createDataFrame([("a", "b", "arrow", 7), ("a", "c", "line", 3)], "src string, dst string, style string, n int")
    bad = spark.createDataFrame([("a", "z", "dots", 7)], "src string, dst string, style string, n int")
    assert gates.report(gates.flow_gate(nodes, good)).first().passed
    assert set(gates.report(gates.flow_gate(nodes, bad)).first().errors) == {"endpoints_known", "styles", "conserved"}


def test_records(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps({"records": [{"paper_title": "A", "year": "2019", "authors": ["Smith, J.", "N/A"], "journal": "J", "keywords": "x; y"}, {"title": "", "publication_year": 0}]}))
    got = records.canonical(records.read_records(spark, str(tmp_path / "r.json"))).orderBy(F.desc_nulls_last("title")).collect()
    assert (got[0].title, got[0].publication_year, got[0].authors, got[0].source_name, got[0].topics) == ("A", 2019, ["Smith, J."], "J", ["x", "y"])
    assert records.merge_spec({"a": 1, "b": {"x": 1, "y": 2}}, {"b": {"y": 3}}) == {"a": 1, "b": {"x": 1, "y": 3}}
    assert records.get_json("x", retries=1, wait=lambda _: 0, get=lambda _: b'{"k": 1}') == ({"k": 1}, "ok")
    (tmp_path / "000.json").write_text('{"results": []}')
    spark.dataSource.register(records.SearchSource)
    rows = spark.read.format("bibspark_search").option("queries", "q one\nq two").option("landing", str(tmp_path)).load().collect()
    assert {(r["query"], r["status"]) for r in rows} == {("q one", "replayed"), ("q two", "missing")}


def test_workflows(spark, tmp_path):
    from bibspark.__main__ import main
    from bibspark.plans import workflows

    rows = [
        {"title": f"Review of tutoring {k}" if k % 2 else f"Learning analytics {k}", "year": 2015 + k % 10, "authors": ["Ann", "Bob", f"C{k % 3}"], "journal": f"J{k % 2}", "institutions": ["U", "V"], "countries": ["US", "CA"], "topics": ["t1", f"t{k % 4}"], "citations": 30 * k}
        for k in range(20)
    ]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    raw = records.read_records(spark, str(tmp_path / "r.json"))
    for run in ("classify", "metadata", "mods", "temporal", "graph"):
        code = main([run, str(tmp_path / "r.json"), str(tmp_path / run)])
        assert code == 0, run
    assert spark.read.json(str(tmp_path / "classify" / "classified")).count() == 20
    figures = workflows.plan_figures(raw, 2015, 2024)
    assert figures["review_gate"].first().passed and figures["other_gate"].first().passed
    nets = workflows.collaboration(raw)
    assert {r.dimension: r.passed for r in nets["statistics"].collect()} == {"authors": True, "institutions": True, "countries": True}
    assert {r.node for r in nets["countries_nodes"].collect()} == {"US", "CA"}
    trend = workflows.temporal_topics(raw, 2015, 2024)["annual_counts"].collect()
    assert {r.n for r in trend} == {2}


def test_expansion(spark):
    schema = "corpus_id string, title string, keys array<string>, direction string, score double, cited_by_count long, in_scope boolean, is_retracted boolean, authors array<string>, source_name string"
    row = lambda i, keys, g, s: (i, f"T {i}", keys, g, s, 1, True, False, ["a"], "j")
    old = spark.createDataFrame([("o1", "T o1", ["k1"])], "corpus_id string, title string, keys array<string>")
    new = spark.createDataFrame([row("c1", ["k1"], "A", 9.0), row("c2", ["k2"], "A", 8.0), row("c3", ["k2"], "B", 9.0), row("c4", ["k4"], "B", 1.0)], schema)
    from bibspark.plans import workflows

    out = workflows.expand_corpus(old, new, [("A", 1), ("B", 1)], 1, "T c2")
    assert {(r.corpus_id, r.title) for r in out["selected"].collect()} == {("expanded-001", "T c2"), ("expanded-002", "T c4")} and out["expanded"].count() == 3
    assert out["gate"].first().passed and not workflows.expand_corpus(old, new, [("A", 2)], 1, "T c2")["gate"].first().passed


def test_document_report(spark):
    good = "\\documentclass{article}\n\\begin{document}\n\\title{A}\n\\begin{abstract}x\\end{abstract}\n\\keywords{k}\n" + "".join(f"\\section{{{s}}}\n" for s in ("Introduction", "Methods", "Results", "Discussion", "Conclusion"))
    good += "\\includegraphics{fig/a} \\includegraphics{b.png}\\cite{r}\n\\bibitem{r}\n\\end{document}"
    docs = spark.createDataFrame([(1, good), (2, None)], "doc_id int, text string")
    files = spark.createDataFrame([("fig/a.svg", "图"), ("b.png", None)], "path string, text string")
    got = {r.doc_id: r for r in textgate.document_report(docs, files=files).collect()}
    assert got[1].passed and got[1].metrics.resolved_citation_count == 1 and {"documentclass", "title", "section: methods"} <= set(got[2].errors)
    english = {r.doc_id: r.errors for r in textgate.document_report(docs, files=files, language="english").collect()}
    assert english[1] == ["figure_language: fig/a.svg"]
    lost = {r.doc_id: r.errors for r in textgate.document_report(docs, files=files.where("path = 'b.png'"), min_figures=1).collect()}
    assert lost[1] == ["too_few_figures", "file: fig/a"]
