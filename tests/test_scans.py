"""Order and byte ranges of scans, on files cut into many splits."""

import json
import random

import pytest
from pyspark.sql import functions as F

from bibspark.plans import workflows
from bibspark.sources import records, scans

SPLIT = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def small_splits(spark):
    had = {k: spark.conf.get(k) for k in (SPLIT, "spark.sql.files.openCostInBytes")}
    spark.conf.set(SPLIT, "15000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in had.items():
        spark.conf.set(k, v)


def record(r, k):
    text = r.choice(["a}b", 'x{"', '"]},{"', "\\", "é\n\\\"", "plain", '"records": [']) * r.randrange(4)
    return {"id": k, "t": text, "n": {"a": [{"b": r.choice(["}", "]"])} for _ in range(r.randrange(3))]}, "l": [[1], [2]]} if k % 17 else {}


@pytest.mark.parametrize(("indent", "envelope"), [(None, False), (2, False), (1, True)])
def test_json_lists_by_ranges(spark, small_splits, tmp_path, indent, envelope):
    r, want = random.Random(5), []
    for name, n in (("a", 3), ("b", 300), ("c", 0), ("d", 60)):
        entries = []
        for k in range(n):
            entries.append(record(r, k))
            want.append(entries[-1])
            if k % 7 == 0:
                entries.append(r.choice([1, "s}", [{"no": 1}], None, [[{"z": "]"}] * 400], [[]]]))
        if name == "d":
            entries.append({"big": ["x}"] * 8000})
            want.append(entries[-1])
        whole = {"meta": {"n": [{"q": 1}], "records": [{"bad": 1}]}, "records": entries, "tail": [{"x": 2}]} if envelope else entries
        (tmp_path / f"{name}.json").write_text(json.dumps(whole, indent=indent, ensure_ascii=False), encoding="utf-8")
    got = scans.json_objects(spark, str(tmp_path)).orderBy("ordinal").collect()
    assert [json.loads(g.text) for g in got] == want
    assert [g.ordinal for g in got] == list(range(1, len(want) + 1))
    assert scans._pieces(spark, str(tmp_path)).rdd.getNumPartitions() > 4
    rows = records.read_records(spark, str(tmp_path) + "/*.json", ordinal="n°")
    assert rows.count() == len(want) and rows.where("id = 299").first()["n"].a is not None


def test_same_rows_as_in_one_task(spark, small_splits, tmp_path):
    entries = [{"id": k, "year": 2000 + k % 7 if k % 3 else None, "authors": [f"A{k}", "ü"], "deep": {"x": [k / 2]}} for k in range(900)]
    path = tmp_path / "r.json"
    path.write_text(json.dumps(entries))
    one, many = spark.read.option("multiLine", True).json(str(path)), records.read_records(spark, str(path))
    assert one.schema == many.schema and one.exceptAll(many).isEmpty() and many.exceptAll(one).isEmpty()


@pytest.mark.parametrize("text", ["", "[{}", '[{"a": "}]', '{"a": 1}}', "7", '"x"'])
def test_broken_files_are_errors(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text + " ")
    with pytest.raises(ValueError, match="list|brackets"):
        scans.json_objects(spark, str(tmp_path / "x.json"))


def test_strict_wants_a_list(spark, tmp_path):
    (tmp_path / "x.json").write_text('{"records": [{"a": 1}]}')
    assert records.read_records(spark, str(tmp_path / "x.json")).first()["a"] == 1
    with pytest.raises(ValueError, match="list"):
        records.read_records(spark, str(tmp_path / "x.json"), strict=True)
    with pytest.raises(ValueError, match="neither"):
        records.read_records(spark, str(tmp_path / "x.txt"), strict=True)


@pytest.mark.parametrize("kind", ["jsonl", "csv", "parquet"])
def test_numbers_go_by_files_whatever_their_sizes(spark, small_splits, tmp_path, kind):
    path, start = tmp_path / f"t.{kind}", 0
    path.mkdir()
    for name, n in (("f0", 300), ("f1", 6000), ("f2", 2000), ("f3", 1)):
        rows = range(start, start + n)
        start += n
        if kind == "jsonl":
            (path / name).write_text("".join(json.dumps({"k": k, "s": "x" * (k % 40)}) + "\n" for k in rows))
        elif kind == "csv":
            (path / name).write_text("k,s\n" + "".join(f"{k},{'x' * (k % 40)}\n" for k in rows))
        else:
            spark.range(rows[0], rows[-1] + 1, 1, 1).withColumnRenamed("id", "k").write.parquet(str(path / name))
    df = spark.read.option("recursiveFileLookup", True).parquet(str(path)) if kind == "parquet" else None
    got = scans.numbered(df, "n") if df is not None else records.read_records(spark, str(path), ordinal="n")
    assert got.where(F.col("n") != F.col("k").cast("long") + 1).isEmpty() and got.count() == start


def test_rows_of_no_file_go_by_partition(spark):
    rows = scans.numbered(spark.createDataFrame([(k,) for k in range(50)], "a int").repartition(1).sortWithinPartitions("a"))
    assert [(r.a, r.ordinal) for r in rows.orderBy("a").collect()] == [(k, k + 1) for k in range(50)]


def test_json_lists_written_and_read(spark, tmp_path):
    df = spark.range(0, 100, 1, 4).select("id", F.concat(F.lit("t}"), "id").alias("t"))
    records.write_json_lists(df, str(tmp_path / "l.json"))
    for part in (tmp_path / "l.json").glob("part*"):
        assert isinstance(json.loads(part.read_text()), list)
    got = records.read_records(spark, str(tmp_path / "l.json"), ordinal="n").orderBy("n").select("n", "id", "t").collect()
    assert [tuple(r) for r in got] == [(k + 1, k, f"t}}{k}") for k in range(100)]
    records.write_json_lists(df.limit(0), str(tmp_path / "none.json"))
    assert scans.json_objects(spark, str(tmp_path / "none.json")).isEmpty()


def test_first_spellings_and_ties_of_a_run(spark, tmp_path):
    rows = [
        {"title": "One", "authors": ["B", "A"], "journal": "J", "year": 2020, "topics": ["AI", "Tutor"], "affiliations": ["U"], "citations": 2, "countries": ["US"]},
        {"title": "Two", "authors": ["b", "C"], "journal": "j", "year": 2021, "topics": ["tutor", "ai"], "affiliations": ["V"], "citations": 2, "countries": ["GB"]},
    ]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    raw = records.read_records(spark, str(tmp_path / "r.json"), ordinal=records.ORDINAL)
    out = workflows.bibliometric_graph(raw)
    labels = {r.id: r.label for r in out["nodes"].collect()}
    assert (labels["author:b"], labels["journal:j"], labels["topic:ai"]) == ("B", "J", "AI")
    top = [r.id for r in out["top_nodes"].collect()]
    assert top == ["author:b", "journal:j", "topic:ai", "topic:tutor", "author:a", "year:2020", "affiliation:u", "author:c", "year:2021", "affiliation:v"]
    windows = workflows.temporal_topics(raw, 2015, 2021)["topic_counts"].orderBy("rank").collect()
    assert [(r.topic, r["rank"]) for r in windows] == [("AI", 1), ("Tutor", 2), ("tutor", 3), ("ai", 4)]
    done = workflows.classify_corpus(raw)
    assert [r.corpus_id for r in done["classified"].orderBy("ordinal").collect()] == ["original-001", "original-002"]
    assert [r.label for r in done["countries"].orderBy("rank").collect()] == ["US", "GB"]
