"""Scores of the language model against interpolated modified Kneser-Ney by dictionaries."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest

from bibspark.llm import lm_scoring


def brute_model(texts):
    bigrams, unigrams = Counter(), Counter()
    for text in texts:
        tokens = [*text.lower().encode().split(), "<end>"]
        unigrams.update(tokens)
        bigrams.update(zip(["<begin>", *tokens], tokens, strict=False))

    def discounts(counts):
        n = Counter(counts)
        if not (n[1] and n[2] and n[3]):
            return [0, 0.5, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        raw = [k - (k + 1) * y * n[k + 1] / n[k] for k in (1, 2, 3)]
        return [0, *(min(max(d, 0.01), k - 0.01) for k, d in zip((1, 2, 3), raw, strict=True))]

    before, after = Counter(w for _, w in bigrams), defaultdict(Counter)
    for (v, w), n in bigrams.items():
        after[v][w] = n
    d2, d1, mass = discounts(bigrams.values()), discounts(before.values()), sum(before.values())

    def p1(w):
        rest = sum(d1[min(k, 3)] for k in before.values()) / mass
        return max(before[w] - d1[min(before[w], 3)], 0) / mass + rest / (len(unigrams) + 1)

    def p2(v, w):
        total = sum(after[v].values())
        if not total:
            return p1(w)
        n = after[v][w]
        return max(n - d2[min(n, 3)], 0) / total + sum(d2[min(k, 3)] for k in after[v].values()) / total * p1(w)

    def score(text):
        tokens = [*text.lower().encode().split(), "<end>"]
        return sum(math.log10(p2(v, w)) for v, w in zip(["<begin>", *tokens], tokens, strict=False))

    return score


def test_scores(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(words[: rng.randint(2, 60)]) for _ in range(rng.randint(0, 80))) for _ in range(150)]
    texts[3], texts[9] = "", "new words only here"
    texts[12] = " ".join(["w1 w2"] * 700)  # counts beyond one byte
    rows = [(k, t if k != 3 else None, "x") for k, t in enumerate(texts)] + [(None, texts[5], "y"), (7, texts[7], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(4)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    score = brute_model([t or "" for i, t, _ in rows if not held(i)])
    want = sorted((repr(i), round(score(t or ""), 8)) for i, t, _ in rows)
    assert sorted((repr(r.doc_id), round(r.score, 8)) for r in lm_scoring.score_documents(docs).collect()) == want


def test_a_lost_shard_is_an_error(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b d")], "doc_id long, text string")
    model = lm_scoring.train(docs) | {"folder": "/nowhere"}
    with pytest.raises(Exception, match="nowhere"):
        lm_scoring.score(docs, model).collect()
