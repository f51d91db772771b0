"""Search answers from landing to expansion, Crossref, MODS and reference cases of the gates."""

import json
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from bibspark.operators import aggregates as agg
from bibspark.operators import classify, gates, graph, search
from bibspark.operators import taxonomy as tx
from bibspark.plans import workflows
from bibspark.sources import records


def work(k, title, abstract="", **more):
    index = {}
    for p, w in enumerate(abstract.split()):
        index.setdefault(w, []).append(p)
    return {
        "id": f"https://openalex.org/W{k}", "doi": f"https://doi.org/10.1/{k}", "title": title, "publication_year": 2020, "type": "article", "cited_by_count": k, "is_retracted": False,
        "authorships": [{"author": {"display_name": "Ann"}, "countries": ["US"], "institutions": [{"display_name": "U", "country_code": "US"}]}],
        "primary_location": {"source": {"display_name": "J", "type": "journal", "is_core": True}}, "topics": [{"display_name": "Education"}], "abstract_inverted_index": index,
    } | more


ROBOT = "Students learn with an educational robot supported by artificial intelligence in education"


@pytest.fixture
def landed(spark, tmp_path):
    q1, q2 = tx.DIRECTION_QUERIES["F03"]
    (m1, *_), (f1, _) = tx.DIRECTION_QUERIES["M01"], tx.DIRECTION_QUERIES["F01"]
    robots = [work(k, f"An educational robot for learning {k}", ROBOT) for k in range(1, 8)]
    first = [*robots, work(20, "Cancer prognosis", "cells"), work(21, "Educational robot", ROBOT, authorships=[]), work(22, "An original educational robot", ROBOT)]
    answers = [
        (q1, "ok", json.dumps({"results": first})), (q2, "ok", json.dumps({"results": [robots[2] | {"cited_by_count": 9000}]})), (f1, "error: TimeoutError", None),
        (m1, "ok", json.dumps({"results": [work(30, tx.REFERENCE_TITLE, "A bibliometric review of artificial intelligence in education")]})), ("unasked", "ok", "{}"),
    ]
    records.land(spark.createDataFrame(answers, "query string, status string, raw string"), str(tmp_path / "raw"))
    return records.replay(spark, str(tmp_path / "raw"))


def test_expansion(spark, landed):
    originals = spark.createDataFrame([("original-001", "An original educational robot", ["title:an original educational robot"])], "corpus_id string, title string, keys array<string>")
    rows = search.judged(search.works_found(landed), originals).collect()
    reasons = {(r.openalex_id, r.query): r.reason for r in rows}
    q1, q2 = tx.DIRECTION_QUERIES["F03"]
    assert reasons["W1", q1] is None and reasons["W20", q1] == reasons["W21", q1] == "scope_or_metadata" and reasons["W22", q1] == "duplicate_of_original"
    assert next(r for r in rows if r.openalex_id == "W1").abstract == ROBOT
    out = workflows.expand_from_search(originals, landed, [("F03", 5), ("M01", 1)], 1)
    picked = out["selected"].collect()
    assert sorted(r.openalex_id for r in picked) == ["W3", "W30", "W4", "W5", "W6", "W7"]
    assert next(r for r in picked if r.openalex_id == "W3").cited_by_count == 9000
    gate = out["gate"].first()
    assert gate.passed and gate.quotas_met, gate
    assert {(r["query"], r.outcome): r.n for r in out["search_log"].collect()}[q1, "scope_or_metadata"] == 2
    short = workflows.expand_from_search(originals, landed, [("F03", 50), ("M01", 1)], 1)["gate"].first()
    assert not short.passed and "quotas_met" in short.errors and "target_met" in short.errors


def test_queries_and_attempts():
    assert sum(map(len, tx.DIRECTION_QUERIES.values())) == 19 and list(tx.DIRECTION_QUERIES) == [d.code for d in tx.EDUCATION_DIRECTIONS]
    waits = []
    data, status = records.get_json("u", retries=2, wait=lambda k: waits.append(k) or 0, get=lambda u: 1 / 0)
    assert data is None and status == "error: ZeroDivisionError" and waits == [0, 1]
    assert records.crossref("") == (None, "missing_doi")
    asked = []
    assert records.crossref("10.1/a b", get=lambda u: asked.append(u) or '{"message": {"title": ["x"]}}') == ({"title": ["x"]}, "ok")
    assert asked == ["https://api.crossref.org/works/10.1%2Fa%20b"]


def test_mods_document(spark):
    rows = [("T & <x>", "Sub", ["A B", "C"], 2020, "article", "10.1/x", "J", "abs", ["t1", "t2"], "3", None, "12-34", ["1234-5678"], "http://u")]
    names = "title string, subtitle string, authors array<string>, year int, work_type string, doi string, source_name string, abstract string, topics array<string>, volume string, issue string, page string, issn array<string>, url string"
    df = spark.createDataFrame(rows, names)
    x = ET.fromstring(df.select(records.mods(df).alias("x")).first().x)
    assert x.find("titleInfo/title").text == "T & <x>" and x.find("titleInfo/subTitle").text == "Sub" and [n.find("namePart").text for n in x.findall("name")] == ["A B", "C"]
    assert x.find("identifier").attrib == {"type": "doi"} and x.find("originInfo/dateIssued").attrib == {"encoding": "w3cdtf"} and x.find("location/url").text == "http://u"
    host = x.find("relatedItem")
    assert host.find("titleInfo/title").text == "J" and host.find("identifier").text == "1234-5678" and host.find("part/detail/number").text == "3" and host.find("part/extent/end").text == "34"
    assert [s.find("topic").text for s in x.findall("subject")] == ["t1", "t2"]
    plain = df.select("title", "authors", "year", "work_type", F.lit(None).cast("string").alias("doi"), "source_name", "abstract", "topics")
    y = ET.fromstring(plain.select(records.mods(plain).alias("x")).first().x)
    assert y.find("identifier") is None and y.find("relatedItem/part") is None and y.find("location") is None


@pytest.mark.parametrize(
    ("title", "abstract", "wrong", "direction"),
    [
        ("A learning platform and its impact on students", "The educational platform uses machine learning for course analytics.", {"T01", "T02", "T16"}, None),
        ("An Intelligent Tutoring System for Autistic Learners", "The tutor supports special education students in classroom learning.", {"O01"}, "F01"),
    ],
)
def test_classifier_cases(spark, title, abstract, wrong, direction):
    df = spark.createDataFrame([(title, abstract)], "title string, abstract string")
    r = classify.classify(df).select("primary_code", classify.directions(F.concat_ws(" ", "title", "abstract")).alias("d")).first()
    assert r.primary_code not in wrong and (direction is None or direction in r.d)


@pytest.mark.parametrize(
    ("code", "title", "abstract"),
    [
        ("F06", "Feedback seeking in higher education and a deep learning approach", "Students describe their goal orientation and study habits."),
        ("F07", "EEG Based Emotion Recognition: A Tutorial and Review", "Educational applications are mentioned among many domains."),
    ],
)
def test_direction_scores_below_zero(spark, code, title, abstract):
    d = next(x for x in tx.EDUCATION_DIRECTIONS if x.code == code)
    df = classify.classify(spark.createDataFrame([(title, abstract)], "title string, abstract string"))
    no = F.lit(False)
    score = classify.direction_score(d, F.concat_ws(" ", "title", "abstract"), F.col("title"), F.col("primary_code"), F.lit(0), no, no, no, no, no)
    assert df.select(score.alias("s")).first().s < 0


def test_collaboration_cases(spark):
    sparse = spark.createDataFrame([(["US", "CA"] if k == 0 else [],) for k in range(8)], "countries array<string>")
    gate = gates.dimension_gate(gates.dimension_stats(sparse, "countries", graph.collaboration_edges(sparse, "countries"))).first()
    assert gate.coverage == 0.125 and not gate.passed
    authorships = [{"author": {"display_name": n}, "countries": [c], "institutions": [{"display_name": i, "country_code": c}]} for n, c, i in (("Alice", "US", "Alpha"), ("Bob", "CA", "Beta"))]
    schema = "authorships array<struct<author:struct<display_name:string>,countries:array<string>,institutions:array<struct<display_name:string,country_code:string>>>>"
    r = spark.createDataFrame([(authorships,)], schema).select(*[records.nested(x).alias(x) for x in ("authors", "institutions", "countries")]).first()
    assert tuple(r) == (["Alice", "Bob"], ["Alpha", "Beta"], ["US", "CA"])
    works = spark.createDataFrame([(["a", "b"],), (["b", "c"],), (["d", "e"],), (["f"],)], "v array<string>")
    edges = graph.collaboration_edges(works, "v")
    r = gates.with_graph_stats(gates.dimension_stats(works, "v", edges), works, "v", edges).first()
    assert (r.unique_nodes, r.connected_nodes, r.components, r.edges) == (6, 5, 2, 3)


def test_temporal_cases(spark):
    works = spark.createDataFrame([(2019 + k, ["t"]) for k in range(6)], "year int, topics array<string>")
    gate = gates.report(gates.temporal_gate(agg.annual_counts(works, 2019, 2030), agg.topic_window_counts(works, 2030, 5))).first()
    assert not gate.passed and "recent_has_topics" in gate.errors
    counts = spark.createDataFrame([(y, 3 * y * y - 2 * y + 5) for y in range(-3, 4)], "year int, n long")
    fit = agg.quadratic_trend(counts).first()
    assert [round(x, 6) for x in fit] == [3, -2, 5, 1]
    two = agg.quadratic_trend(spark.createDataFrame([(2000, 4), (2001, 6)], "year int, n long")).first()
    assert (two.a, two.b) == (0, 0) and two.c == pytest.approx((0.25 * 10 + 1 + 10) / 1)


def test_command_line_expands(spark, tmp_path, landed):
    from bibspark.__main__ import main

    (tmp_path / "r.json").write_text(json.dumps([{"title": "An original educational robot", "year": 2019, "authors": ["A"], "journal": "J", "topics": ["x"]}]))
    assert main(["classify", str(tmp_path / "r.json"), str(tmp_path / "out"), "--answers", str(tmp_path / "raw"), "--originals", "1"]) == 1  # too few answers for the quotas
    assert spark.read.json(str(tmp_path / "out" / "selected")).count() == 6
    ids = workflows.identified(records.read_records(spark, str(tmp_path / "r.json"))).first()
    assert ids.corpus_id == "original-001" and ids["keys"] == ["title:an original educational robot"]
