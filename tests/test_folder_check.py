"""The document gate over folders: documents, .bib files, graphics, ledgers and figure reports as files."""

import json

import pytest
from pyspark.sql import functions as F

from bibspark.__main__ import main
from bibspark.plans import workflows
from bibspark.sources import documents

HEAD = "\\documentclass{article}\n\\title{A review of some evidence}\n\\begin{document}\n\\begin{abstract}\nIt sums the evidence up.\n\\end{abstract}\n\\keywords{evidence; review}\n"
PARTS = "".join(f"\\section{{{s}}}\nSome words about this part \\cite{{smith2024}}.\n" for s in ("Introduction", "Dataset and methods", "Results", "Discussion", "Conclusion"))
FIGURE = "\\begin{figure}\n\\includegraphics{%s}\n\\caption{A map.}\n\\label{fig:map}\n\\end{figure}\n"


def complete(folder, figure="figure.png", bib="refs"):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "figure.png").write_bytes(b"\x89PNG no picture")
    (folder / "refs.bib").write_bytes("@article{smith2024,\n title={Müller}\n}\n".encode("latin-1"))
    (folder / "review.tex").write_text(HEAD + PARTS + FIGURE % figure + f"\\bibliography{{{bib}}}\n\\end{{document}}\n")
    return folder / "review.tex"


def report(spark, path, **how):
    return workflows.check_folder(spark, str(path), **how)["report"].collect()


def test_complete_document_passes(spark, tmp_path):
    complete(tmp_path)
    (r,) = report(spark, tmp_path, min_words=40, min_figures=1)
    assert r.passed and r.errors == [] and r.warnings == []
    assert r.metrics.figure_count == 1 and r.metrics.citation_count == r.metrics.resolved_citation_count == 1
    assert r.metrics.required_sections["methods"] == "dataset and methods"
    assert main(["check", str(tmp_path / "review.tex"), str(tmp_path / "out"), "--min-words", "40", "--min-figures", "1"]) == 0
    assert main(["check", str(tmp_path), str(tmp_path / "out"), "--min-words", "4000"]) == 1


def test_broken_document_fails(spark, tmp_path):
    text = "\\documentclass{article}\n\\begin{document}\nPrompt: write it.\n```markdown\n# Draft\n```\n\\begin{abstract}\nTODO\n\\end{abstract}\n\\section{Background} \\cite{missing2025} [insert synthesis].\n\\section{Methodology}\n\\section{Findings}\n"
    (tmp_path / "broken.tex").write_text(text + "\\begin{figure}\n\\includegraphics{missing-image.png}\n\\caption{No label.}\n\\end{figure}\n\\end{document}\n")
    (r,) = report(spark, tmp_path, min_words=200, min_figures=2)
    assert not r.passed
    assert {"title", "keywords", "section: discussion", "section: conclusion", "caption_or_label", "file: missing-image.png", "citation: missing2025", "no_bibliography", "too_few_words", "too_few_figures"} <= set(r.errors)
    assert sum(e.startswith("leak: ") for e in r.errors) >= 4


def test_names_are_resolved_against_each_document(spark, tmp_path):
    complete(tmp_path / "a" / "text", "../img/./map", "../refs")
    complete(tmp_path / "b")
    (tmp_path / "a" / "img").mkdir()
    (tmp_path / "a" / "img" / "map.pdf").write_bytes(b"x")
    (tmp_path / "a" / "refs.bib").write_text("@book{smith2024,}")
    complete(tmp_path / "c", str(tmp_path / "b" / "figure.png"))
    (tmp_path / "c" / "refs.bib").unlink()
    got = {r.doc_id.rpartition("/")[0].rpartition(str(tmp_path))[2]: r for r in report(spark, tmp_path)}
    assert got["/a/text"].passed and got["/b"].passed
    assert got["/c"].errors == ["no_bibliography", "citation: smith2024"] and [w.rpartition("/")[2] for w in got["/c"].warnings] == ["refs.bib"]


def test_ledger_questions_and_reports(spark, tmp_path):
    complete(tmp_path)
    claim = {"claim_id": "RQ1-a", "claim": "c", "sources": ["smith2024"], "evidence": ["e"], "confidence": "High"}
    how = {"ledger": "ledger.json", "questions": ["RQ1"], "reports": ["fig.json"]}
    (tmp_path / "fig.json").write_text('{"validation": {"passed": true}}')
    (tmp_path / "ledger.json").write_text(json.dumps({"claims": [claim]}))
    (r,) = report(spark, tmp_path, **how)
    assert r.errors == [] and (r.metrics.claim_count, r.metrics.question_count, r.metrics.covered_question_count) == (1, 1, 1)
    (tmp_path / "ledger.json").write_text(json.dumps([claim | {"claim_id": "RQ2", "sources": ["other"]}, "no object", {"confidence": "sure"}, claim | {"sources": "smith2024"}]))
    (r,) = report(spark, tmp_path, **how | {"reports": ["fig.json", "gone.json"], "questions": ["RQ1", "RQ3"]})
    assert [e if not e.startswith("figure") else e.rpartition("/")[2] for e in r.errors] == [
        "claim: no object", "claim: RQ2: unresolved_source other", "claim: #2: claim_id", "claim: #2: claim", "claim: #2: sources", "claim: #2: evidence", "claim: #2: confidence", "claim: RQ1-a: sources", "question: RQ3", "gone.json",
    ]
    for text, fault in (("7", "no list"), ("[", "no list"), (None, "no ledger")):
        (tmp_path / "ledger.json").unlink(missing_ok=True)
        if text:
            (tmp_path / "ledger.json").write_text(text)
        (r,) = report(spark, tmp_path, ledger="ledger.json", questions=["RQ1"])
        assert r.errors == [f"claim: {fault}", "question: RQ1"]
    (r,) = report(spark, tmp_path, questions=["RQ1"])
    assert r.errors == ["claim: questions without a ledger", "question: RQ1"]
    assert main(["check", str(tmp_path / "review.tex"), str(tmp_path / "out"), "--questions", "rq1"]) == 1


def test_script_of_figure_sources(spark, tmp_path):
    complete(tmp_path)
    (tmp_path / "figure.svg").write_text("<text>图</text>", encoding="utf-8")
    (r,) = report(spark, tmp_path, language="english")
    assert [e.partition(":")[0] for e in r.errors] == ["figure_language"] and len(r.metrics.non_english_figure_sources) == 1
    assert report(spark, tmp_path)[0].passed


@pytest.mark.parametrize(
    ("folder", "name", "path"),
    [("file:/a/b", "c.png", "file:/a/b/c.png"), ("file:/a/b", "../c/./d", "file:/a/c/d"), ("file:/a", "../../x", "file:/x"), ("hdfs://h:1/a", "/z/q", "hdfs://h:1/z/q"), ("hdfs://h:1/a/b", "../c", "hdfs://h:1/a/c"), ("/a", "b//c", "/a/b/c")],
)
def test_paths(spark, folder, name, path):
    assert spark.range(1).select(documents.resolved(F.lit(folder), F.lit(name))).first()[0] == path


def test_a_folder_without_documents(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(b"x")
    assert report(spark, tmp_path) == []
