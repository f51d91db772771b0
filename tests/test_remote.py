"""Runs against a server stub that counts: rate, landing, reruns after a kill, files and manifests."""

import json
import threading
import time
import xml.etree.ElementTree as ET
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import unquote

import pytest
from pyspark.sql import functions as F

from bibspark.plans import remote_runs
from bibspark.sources import remote


class Stub(BaseHTTPRequestHandler):
    answers: dict = {}
    asked: Counter = Counter()
    times: list = []

    def do_GET(self):
        path = unquote(self.path.partition("?")[0])
        type(self).asked[path] += 1
        type(self).times.append(time.time())
        answer = self.answers.get(path)
        if isinstance(answer, list):  # one after the other
            answer = answer[min(self.asked[path], len(answer)) - 1]
        code = 404 if answer is None else answer if isinstance(answer, int) else 200
        self.send_response(code)
        self.end_headers()
        if code == 200:
            self.wfile.write(answer.encode() if isinstance(answer, str) else json.dumps(answer).encode())

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    stub = ThreadingHTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=stub.serve_forever, daemon=True).start()
    Stub.answers, Stub.asked, Stub.times = {}, Counter(), []
    yield f"http://127.0.0.1:{stub.server_port}"
    stub.shutdown()


def test_slots_of_lanes_do_not_meet():
    clock = [100.03]
    used = []
    for i in range(3):
        lane = remote.Lane(i, 3, 10.0, lambda: clock[0], lambda s: clock.__setitem__(0, clock[0] + s))
        clock[0] = 100.03
        for _ in range(5):
            lane.wait()
            used.append(round(clock[0], 6))
        clock[0] += 0.001
    assert len(set(used)) == 15
    gaps = [b - a for a, b in zip(sorted(used), sorted(used)[1:], strict=False)]
    assert min(gaps) > 0.0999 and max(gaps) < 0.1001


def test_one_rate_for_the_whole_job(spark, server, tmp_path):
    Stub.answers = {f"/{k}": {"k": k} for k in range(24)}
    requests = spark.createDataFrame([(f"{k}", f"{server}/{k}") for k in range(24)] + [("none", None), ("3", f"{server}/3")], "key string, url string").repartition(8)
    got = remote.fetch(requests, str(tmp_path / "land"), lanes=4, per_second=12.0)
    assert {r.key: json.loads(r.raw)["k"] for r in got.collect()} == {f"{k}": k for k in range(24)}
    assert set(Stub.asked.values()) == {1}
    times = sorted(Stub.times)
    for a in times:  # no second has more than the rate, and one more at its edge
        assert sum(a <= t < a + 1 for t in times) <= 13
    assert times[-1] - times[0] > 1.5


def test_answers_and_retries(spark, server, tmp_path):
    Stub.answers = {"/a": {"x": 1}, "/busy": [503, 503, {"x": 2}], "/down": 500, "/text": "no json"}
    requests = spark.createDataFrame([(k, f"{server}/{k}") for k in ("a", "busy", "down", "text", "gone")], "key string, url string")
    land = str(tmp_path / "land")
    got = {r.key: (r.status, r.raw) for r in remote.fetch(requests, land, per_second=200.0).collect()}
    assert got["a"] == ("ok", '{"x": 1}') and got["busy"] == ("ok", '{"x": 2}') and got["gone"] == ("not_found", None)
    assert got["down"] == ("error: HTTPError", None) and got["text"] == ("error: JSONDecodeError", "no json")
    assert Stub.asked == {"/a": 1, "/busy": 3, "/down": 3, "/text": 3, "/gone": 1}
    Stub.answers["/down"] = {"x": 3}
    again = {r.key: r.status for r in remote.fetch(requests, land, per_second=200.0).collect()}
    assert again == {"a": "ok", "busy": "ok", "gone": "not_found", "down": "ok", "text": "error: JSONDecodeError"}
    assert Stub.asked == {"/a": 1, "/busy": 3, "/down": 4, "/text": 6, "/gone": 1}  # only what was missing


def test_a_killed_run_asks_only_the_rest(spark, server, tmp_path):
    Stub.answers = {f"/{k}": {"k": k} for k in range(40)}
    requests = spark.createDataFrame([(f"{k}", f"{server}/{k}") for k in range(40)], "key string, url string")
    land, flag = str(tmp_path / "land"), tmp_path / "killed"

    def dying(url):
        if not flag.exists() and url.endswith("/17"):
            flag.touch()
            raise SystemExit  # no Exception: ends the worker
        return remote.http_get(url)

    dying_once = {"get": dying, "wave": 10, "per_second": 500.0}
    try:
        remote.fetch(requests, land, **dying_once)
    except Exception:  # noqa: BLE001 - local mode has one attempt a task
        assert remote.landed(spark, land).count() < 40
    done = {f"/{r.key}" for r in remote.landed(spark, land).collect()}
    before = Counter(Stub.asked)
    assert remote.fetch(requests, land, **dying_once).count() == 40
    assert all(Stub.asked[p] == before[p] for p in done) and set(Stub.asked) == set(Stub.answers)


def test_files_are_whole_and_the_manifest_is_what_was_committed(spark, tmp_path):
    folder = str(tmp_path / "out")
    rows = [(k, f"f{k}", None if k == 4 else f"text {k}" * 1000, "failed" if k == 4 else "ok") for k in range(9)]
    df = spark.createDataFrame(rows, "index int, name string, text string, status string").repartition(3)
    broken = df.withColumn("text", F.when(F.col("index") == 7, F.expr("cast(raise_error('killed') as string)")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="killed"):
        remote.write_files(broken, folder)
    assert not [p for p in (tmp_path / "out" / "_manifest").glob("*.json")]
    for p in (tmp_path / "out").glob("f*"):
        assert p.read_text() == f"text {p.name[1:]}" * 1000
    seen = {r["name"]: r["exists"] for r in remote.with_existing(df, folder).collect()}
    assert seen == {f"f{k}": (tmp_path / "out" / f"f{k}").exists() for k in range(9)}
    manifest = {r["index"]: r for r in remote.write_files(df, folder).collect()}
    assert sorted(manifest) == list(range(9)) and manifest[4]["file"] == "" and "text" not in manifest[4].asDict()
    assert all((tmp_path / "out" / f"f{k}").read_text() == f"text {k}" * 1000 and manifest[k]["file"].endswith(f"/f{k}") for k in range(9) if k != 4)
    assert not list((tmp_path / "out").glob(".*.tmp"))
    assert {r["index"] for r in remote.write_files(df.where("index < 2"), folder).collect()} == {0, 1}  # of this run alone


RECORDS = [
    {"title": "One: a study?", "doi": "https://doi.org/10.1/One", "authors": "Local, A.; Local, B.", "source_name": "Local Journal", "abstract": "<p>Local words</p>", "concepts": ["AI"], "publication_year": 2019, "landing_page_url": "http://l"},
    {"title": "Two", "openalex_id": "https://openalex.org/W2", "publication_year": 2020, "concepts": "x; X"},
    {"title": "Three", "doi": "10.1/three"},
    {"title": "Four"},
]
CROSS = {
    "message": {
        "DOI": "10.1/One", "title": ["Cross one"], "subtitle": ["Sub"], "type": "journal-article", "publisher": "P", "author": [{"given": "C.", "family": "Ross"}, {"family": "Only"}], "ISSN": ["1-1"], "volume": "7", "page": "3-9",
        "container-title": ["Cross Journal"], "abstract": "<jats:p>Cross words</jats:p>", "published-print": {"date-parts": [[2018, 3]]}, "relation": {"any": 1},
    }
}
WORK = {
    "id": "https://openalex.org/W2", "title": "Index two", "type": "article", "publication_date": "2020-05-06", "publication_year": 2020, "cited_by_count": 12, "doi": "https://doi.org/10.1/TWO",
    "authorships": [{"author": {"display_name": "I. Ndex"}, "institutions": [{"display_name": "U"}, {"display_name": "u"}], "countries": ["US"]}, {"author": {"display_name": "S. Econd"}, "institutions": [], "countries": []}],
    "primary_location": {"source": {"display_name": "Index Journal"}, "landing_page_url": "http://i"}, "biblio": {"volume": "1", "first_page": "5", "last_page": "8"}, "primary_topic": {"display_name": "T0"},
    "topics": [{"display_name": "T1"}], "keywords": [{"display_name": "ai"}], "concepts": [{"display_name": "X"}], "abstract_inverted_index": {"words": [1], "Index": [0]},
}


def records_of(spark, tmp_path):
    from bibspark.sources import records

    (tmp_path / "r.json").write_text(json.dumps(RECORDS))
    return records.read_records(spark, str(tmp_path / "r.json"), ordinal=records.ORDINAL)


def test_mods_run(spark, server, tmp_path):
    Stub.answers = {"/c/10.1/One": CROSS, "/w/W2": WORK, "/w/https://doi.org/10.1/One": 500, "/c/10.1/three": 500}
    raw, land, out = records_of(spark, tmp_path), str(tmp_path / "land"), str(tmp_path / "out")
    how = {"crossref_base": f"{server}/c/", "index_base": f"{server}/w/", "per_second": 100.0, "email": "a@b.org"}
    got = {r["index"]: r for r in remote_runs.mods_documents(raw, land, out, **how).collect()}
    assert [(got[k].status, got[k].crossref_status, got[k].openalex_status) for k in (1, 2, 3, 4)] == [
        ("ok", "ok", "error: HTTPError"), ("ok", "missing_doi", "ok"), ("failed", "error: HTTPError", "not_found"), ("failed", "missing_doi", "missing_openalex_ref"),
    ]
    assert got[1]["name"] == "001_One_a_study.mods.xml" and got[4].error == "crossref=missing_doi; openalex=missing_openalex_ref"
    one = ET.parse(tmp_path / "out" / "001_One_a_study.mods.xml").getroot()
    text = lambda root, path: [e.text for e in root.findall(path)]
    assert text(one, "titleInfo/title") == ["Cross one"] and text(one, "titleInfo/subTitle") == ["Sub"] and text(one, "name/namePart") == ["C. Ross", "Only"]
    assert text(one, "originInfo/dateIssued") == ["2018-03"] and text(one, "genre") == ["journal-article"] and text(one, "abstract") == ["Local words"]
    assert text(one, "relatedItem/titleInfo/title") == ["Local Journal"] and text(one, "relatedItem/part/extent/start") == ["3"] and text(one, "subject/topic") == ["AI"] and text(one, "location/url") == ["http://l"]
    two = ET.parse(tmp_path / "out" / "002_Two.mods.xml").getroot()
    assert text(two, "titleInfo/title") == ["Index two"] and text(two, "name/namePart") == ["I. Ndex", "S. Econd"] and text(two, "originInfo/dateIssued") == ["2020-05-06"]
    assert text(two, "abstract") == ["Index words"] and text(two, "identifier") == ["10.1/TWO", "https://openalex.org/W2"] and text(two, "subject/topic") == ["x", "ai"] and text(two, "location/url") == ["http://i"]
    before = Counter(Stub.asked)
    Stub.answers["/c/10.1/three"] = {"message": {"title": ["Now there"]}}
    again = {r["index"]: r for r in remote_runs.mods_documents(raw, land, out, **how).collect()}
    assert [again[k].status for k in (1, 2, 3, 4)] == ["skipped_existing", "skipped_existing", "ok", "failed"]
    assert {p for p in Stub.asked if Stub.asked[p] > before[p]} == {"/c/10.1/three"}
    assert text(ET.parse(tmp_path / "out" / "003_Three.mods.xml").getroot(), "titleInfo/title") == ["Now there"]


def test_metadata_run(spark, server, tmp_path):
    Stub.answers = {"/w/W2": WORK, "/w/https://doi.org/10.1/One": 500}
    rows = remote_runs.metadata(records_of(spark, tmp_path), str(tmp_path / "land"), index_base=f"{server}/w/", per_second=100.0, retries=0)
    assert tuple(rows.columns) == remote_runs.METADATA
    got = {r["index"]: r for r in rows.collect()}
    assert [got[k].metadata_status for k in (1, 2, 3, 4)] == ["error: HTTPError", "ok", "not_found", "local_only"]
    two = got[2]
    assert (two.title, two.authors, two.institutions, two.journal, two.year, two.topics, two.cited_by_count, two.doi, two.openalex_id) == (
        "Index two", ["I. Ndex", "S. Econd"], ["U"], "Index Journal", "2020", ["T0", "T1", "ai", "X"], "12", "10.1/TWO", "https://openalex.org/W2",
    )
    assert got[1].authors == ["Local, A.", "Local, B."] and got[1].journal == "Local Journal" and got[1].topics == ["AI"] and got[1].doi == "10.1/One"
    flat = {r["index"]: r for r in remote_runs.metadata_file(rows).collect()}
    assert flat["2"].author_affiliations == "I. Ndex: U | S. Econd" and flat["1"].author_affiliations == "Local, A. | Local, B." and flat["4"].authors == ""


def test_command_line(spark, server, tmp_path):
    from bibspark.__main__ import main

    Stub.answers = {"/c/10.1/One": CROSS, "/w/W2": WORK}
    (tmp_path / "r.json").write_text(json.dumps(RECORDS))
    common = ["--remote", "--index-base", f"{server}/w/", "--per-second", "100", "--retries", "0"]
    assert main(["metadata", str(tmp_path / "r.json"), str(tmp_path / "m"), *common, "--limit", "2"]) == 0
    rows = spark.read.option("header", True).csv(str(tmp_path / "m" / "paper_metadata_csv"))
    assert tuple(rows.columns) == remote_runs.METADATA and rows.count() == 2
    assert main(["mods", str(tmp_path / "r.json"), str(tmp_path / "x"), *common, "--crossref-base", f"{server}/c/", "--limit", "2"]) == 0
    assert sorted(p.name for p in (tmp_path / "x").glob("*.xml")) == ["001_One_a_study.mods.xml", "002_Two.mods.xml"]
    assert main(["mods", str(tmp_path / "r.json"), str(tmp_path / "x"), *common, "--crossref-base", f"{server}/c/"]) == 1  # two have failed
