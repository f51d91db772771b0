"""Scores and evidence of all five sections against plain loops over the patterns."""

import json
import re

from bibspark.operators.taxonomy import EDUCATION_RULES, WEIGHTS
from bibspark.plans import workflows
from bibspark.sources import records

ROWS = [
    {"title": "An intelligent tutoring   system for learners", "abstract": "Students use machine learning.", "concepts": ["Education", "Chatbot in\n education"], "keywords": "adaptive learning; deep learning", "matched_queries": ["ChatGPT education", "learning analytics"]},
    {"title": "Plain title", "abstract": None, "concepts": [], "keywords": "large language model; student", "matched_queries": ["large language model in education"]},
    {"title": "Machine learning for oncology", "abstract": "Nothing else.", "concepts": None, "keywords": None, "matched_queries": None},
    {"title": None, "abstract": "", "concepts": ["school"], "keywords": "", "matched_queries": []},
]


def space(x):
    return " ".join((x or "").split())


def listed(x):
    items = x if isinstance(x, list) else re.split(r"[;|\n]", x or "")
    return [space(i) for i in items if space(i)]


def by_loops(r):
    sections = {"title": space(r["title"]), "abstract": space(r["abstract"])} | {k: " ; ".join(listed(r[f])) for k, f in (("concepts", "concepts"), ("keywords", "keywords"), ("query", "matched_queries"))}
    scores, evidence = {}, {}
    for rule in EDUCATION_RULES:
        for pattern in rule.patterns:
            for name, text in sections.items():
                if m := re.search(pattern, text, re.I):
                    scores[rule.code] = scores.get(rule.code, 0.0) + WEIGHTS[name]
                    marker = f"{name}:{space(m[0])[:100]}"
                    if marker not in evidence.setdefault(rule.code, []):
                        evidence[rule.code].append(marker)
    return scores, evidence


def test_run_scores_every_section(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps(ROWS))
    raw = records.read_records(spark, str(tmp_path / "r.json"), ordinal=records.ORDINAL)
    out = workflows.classify_corpus(raw)
    done = {r.ordinal: r for r in out["classified"].select("ordinal", "ranked").collect()}
    assert len(done) == 4
    found = {}
    for e in out["evidence"].collect():
        found.setdefault(int(e.corpus_id.rpartition("-")[2]), {})[e.code] = e.evidence
    seen = set()
    for k, row in enumerate(ROWS, 1):
        scores, evidence = by_loops(row)
        assert {e.code: e.score for e in done[k].ranked} == scores
        assert found.get(k, {}) == evidence
        seen |= {m.partition(":")[0] for ms in evidence.values() for m in ms}
    assert {"concepts", "keywords", "query"} <= seen
    assert [e.code for e in done[1].ranked] == sorted((s := by_loops(ROWS[0])[0]), key=lambda c: (-s[c], c))
