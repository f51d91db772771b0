"""Phrases against plain counts: all scores, cuts, covers and ranks, on small alphabets and odd tables."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from bibspark.llm import collocations
from bibspark.llm.collocations import best, pairs_of, positional_lists, slots, triples_of

LOWER = {k: k + 32 for k in range(65, 91)}


def counted(rows, min_count, covered, limit):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    longer = Counter()
    for (lang, p), a in f.items():
        if len(p) == 3 and a >= min_count:
            for q in (p[:2], p[1:]):
                longer[lang, q] = max(longer[lang, q], a)
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < min_count or (len(p) == 2 and longer[lang, p] and 100 * longer[lang, p] >= covered * a):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {o[0] for o in out}:
        own = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))
        ranked += [(*o, r + 1) for r, o in enumerate(own[:limit])]
    return sorted(ranked)


def mined(df, min_count=10, covered=50, limit=2000):
    rows = best(collocations.collocations(df, min_count, covered), limit)
    return sorted(tuple(r) for r in rows.select("lang", "phrase", "a", "l", "r", "n", "score", "rank").collect())


def texts(seed, count, length):
    r = random.Random(seed)
    words = ["a", "B", "Cc", "é", "É", "日本", "d-e", "x", "y"]
    gap = [" "] * 12 + ["  ", "\t", ". ", ",", "\n", "\x0b", " ", ";x", "! ?"]
    return [("".join(r.choice(words) + r.choice(gap) for _ in range(r.randrange(length))), r.choice(["en", "de", None, "", "und"])) for _ in range(count)]


@pytest.mark.parametrize(("seed", "min_count", "covered", "limit"), [(1, 2, 50, 2000), (2, 5, 80, 5), (3, 10, 50, 3)])
def test_against_counts(spark, seed, min_count, covered, limit):
    rows = texts(seed, 60, 80)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    assert mined(df, min_count, covered, limit) == counted(rows, min_count, covered, limit)


def test_many_blocks(spark, monkeypatch):
    """Counts add up over blocks of a few documents each."""
    rows = texts(7, 80, 60)
    from bibspark.llm import common

    whole = common.text_chunks
    monkeypatch.setattr(collocations, "text_chunks", lambda batches: whole(batches, 500))
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    assert mined(df, 4) == counted(rows, 4, 50, 2000)


def test_odd_tables(spark):
    schema = "text string, lang string, word string, id long, block long, f int, e string, at int"
    rows = [(None, None, "w", 1, 2, 3, "e", 4), ("", "en", None, None, None, None, None, None), (" .,; ", "en", "w", 1, 2, 3, "e", 4)]
    rows += [("one two three one two", None, "w", 1, 2, 3, "e", 4)] * 12
    got = mined(spark.createDataFrame(rows, schema))
    assert got == counted([r[:2] for r in rows], 10, 50, 2000) and len(got) > 2
    assert mined(spark.createDataFrame([], schema)) == []
    assert mined(spark.createDataFrame(rows[:3], schema)) == []


def test_text_of_several_megabytes(spark):
    long = ("the same words again and again. " * 200_000)[:-1]
    rows = [(long, "en"), ("the same words", "en")]
    got = mined(spark.createDataFrame(rows, "text string, lang string"))
    assert got == counted(rows, 10, 50, 2000)


def test_scores_beyond_64_bits(spark):
    df = spark.createDataFrame([(3 * 10**9, 3 * 10**9 + 1, 3 * 10**9 + 7)], "a long, l long, r long")
    a, left, right = 3 * 10**9, 3 * 10**9 + 1, 3 * 10**9 + 7
    assert df.select(collocations._score("l", "r")).first()[0] == 10**6 * a * a // (left * right)


def test_lists_of_a_block():
    buf = np.frombuffer("A b,a  b a\tB.".encode() + b"b a", np.uint8)
    words, langs, counts, at = positional_lists(np.array([0, 1]), np.array([0, 13, 16]), buf)
    assert words.to_pylist() == ["a", "b", "b", "a"] or sorted(zip(langs.tolist(), words.to_pylist(), counts.tolist(), strict=True)) == [(0, "a", 3), (0, "b", 3), (1, "a", 1), (1, "b", 1)]
    ids = np.arange(len(words)) * 10
    pairs = {(words[int(a) // 10].as_py(), words[int(b) // 10].as_py(), langs[a // 10]): int(n) for a, b, n in zip(*pairs_of(ids, counts, at), strict=True)}
    assert pairs == {("a", "b", 0): 3, ("b", "a", 0): 1, ("b", "a", 1): 1}
    triples = [t[-1].tolist() for t in [triples_of(ids, counts, at, lambda a, b: np.ones(len(a), bool))]]
    assert triples == [[1, 1]] and triples_of(ids, counts, at, lambda a, b: np.zeros(len(a), bool))[3].tolist() == []


def test_a_full_filter_loses_nothing(spark, monkeypatch):
    """With one bit a pair nearly all pairs pass; the counts stay right."""
    monkeypatch.setattr(collocations, "FILTER_BITS", 1)
    monkeypatch.setattr(collocations, "BITMAP", 8 * 4096)
    rows = texts(9, 50, 60)
    assert mined(spark.createDataFrame(rows, "text string, lang string"), 3) == counted(rows, 3, 50, 2000)
    a = np.arange(1000)
    assert ((slots(a, a + 1, 1 << 15) >= 0) & (slots(a, a + 1, 1 << 15) < 1 << 15)).all()
