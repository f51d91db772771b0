"""The pipeline's near-dedup stage against brute force."""

import random

import numpy as np
import pytest

import corpus_pipeline
from bibspark.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return group


@pytest.mark.parametrize("cell", [1024, 3])
def test_stage_keeps_one_of_each_jaccard_component(spark, monkeypatch, cell):
    monkeypatch.setattr(jaccard, "CELL", cell)
    rng = random.Random(4)
    words = [f"w{k}é" for k in range(300)]
    line = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for k in range(25):
        base = [rng.choice(words) for _ in range(rng.choice((3, 6, 30, 120, 400)))]
        texts.append(" ".join(base) + ("\n" + line if k % 3 else ""))
        for _ in range(6):  # chains of copies with words changed, around the limit
            base = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base).upper() + ("\n" + line if k % 3 else ""))
    texts += [None, "", " \n", "one", "One", texts[0]]
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts)] + [(None, texts[0], "en", "s", 0)]
    group = brute(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    least = {}
    for k, g in enumerate(group):
        least.setdefault(g, k)  # ids ascend; the row without an id comes last
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(least.values())
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs).collect()}
    assert all(got[k] == least[group[k]] for k in range(len(texts)))
    assert jaccard.keep_one(docs.limit(0)).count() == 0


def test_histograms_rule_out_no_similar_pair():
    rng = np.random.default_rng(3)
    for n in (1, 5, 60, 3000, 90_000):
        x = rng.integers(0, 2**64, n, np.uint64)
        for share in (0.95, 0.9, 0.89, 0.7, 0.0):
            y = np.concatenate([x[: int(n * share)], rng.integers(0, 2**64, n - int(n * share), np.uint64)])
            a, b = np.unique(x), np.unique(y)
            bars = [np.frombuffer(jaccard.histogram(s), np.uint8)[None] for s in (a, b)]
            ok = jaccard.possible(*bars, np.array([len(a)]), np.array([len(b)]), 0.8)[0]
            assert ok or not jaccard.similar(a, b, 0.8)
            assert not ok or share > 0 or n in (1, 90_000)
