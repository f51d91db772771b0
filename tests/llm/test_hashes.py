"""Words and vectors that earlier hashes and indexes mixed up or left out."""

import math

import numpy as np
import pytest

from bibspark.llm import common as c
from bibspark.llm import embedding_dedup, lm_scoring, substring_dedup


def thue_morse(n: int) -> tuple[str, str]:
    bits = [bin(k).count("1") % 2 for k in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [1024, 4096])
def test_words_with_equal_polynomials(spark, size):
    """For every odd base these two words have one polynomial hash modulo 2**64."""
    one, two = thue_morse(size)
    for base in c.BASES:
        h = [c.prefix_hash(np.frombuffer(w.encode(), np.uint8), base)[-1] for w in (one, two)]
        assert h[0] == h[1]
    head = " ".join(f"w{k}" for k in range(12))
    docs = spark.createDataFrame([(1, f"{head} {one}"), (2, f"{head} {two}"), (3, f"{head} {one}")], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in substring_dedup.dedup_windows(docs).collect()}
    assert got == {1: 0, 2: 0, 3: 13}
    buf = np.frombuffer(f"{one} {two} {one}".encode(), np.uint8)
    starts, ends, _ = c.word_spans(buf, np.array([0, len(buf)]))
    hashes = c.word_hashes(buf, starts, ends)
    assert hashes[0] != hashes[1] and hashes[0] == hashes[2]


def test_word_hashes_go_by_the_word_alone():
    texts = ["", "a", "  a\tb a", "ä ö", "a"]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    starts, ends, _ = c.word_spans(buf, offs)
    words = [buf[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)]
    assert words == ["a", "a", "b", "a", "ä", "ö", "a"]
    by = {}
    for w, h in zip(words, c.word_hashes(buf, starts, ends).tolist(), strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == 4
    none = np.zeros(0, np.int64)
    assert len(c.word_hashes(np.zeros(0, np.uint8), none, none)) == 0


def test_model_tells_such_words_apart(spark):
    one, two = thue_morse(2048)
    low, offs = np.frombuffer(f"{one} {two}".encode(), np.uint8), np.array([0, 2 * 2048 + 1])
    t, _, _ = lm_scoring.tokens(low, offs)
    assert len(set(t.tolist())) == 3


def test_vectors_of_every_length_link(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [1.0, 0.01, 0.0]), (3, [1.0, 0.0]), (4, [0.9, 0.1]), (5, [0.0, 1.0]), (6, [2.0]), (7, [3.0]), (8, [-1.0]), (9, []), (10, None), (11, [0.0, 0.0]), (12, [math.nan, 1.0]), (13, [1.0, 0.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    want = {}
    unit = {}
    for k, v in rows:
        x = np.array(v or [], float)
        unit[k] = x / np.linalg.norm(x) if len(x) and np.isfinite(x).all() and x.any() else None
    for k in unit:
        links = [j for j in unit if j != k and unit[k] is not None and unit[j] is not None and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= 0.9]
        want[k] = (len(links), min([k, *links]), k == min([k, *links]))
    assert got == want
