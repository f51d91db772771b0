"""Stages keep any columns, handle nulls, repeats and empty tables, and take what the plan says."""

import math
from collections import Counter
from hashlib import md5

import pytest

import corpus_pipeline
from bibspark.llm import jaccard, mixing, simhash

NAMES = ["doc_id", "text", "lang", "source", "copies", "__key", "__id", "__one", "key", "row", "size", "rank", "score", "fp", "n th"]
SCHEMA = "doc_id long, text string, lang string, source string, copies int, __key string, __id long, __one int, key string, row string, size double, rank int, score double, fp long, `n th` int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = []
    for k in range(120):
        text = " ".join(f"w{(k * 7 + j * (1 + k % 9)) % 50}" for j in range(k % 40))
        rows.append((k if k % 10 else None, text if k % 13 else None, "en", None if k % 7 == 0 else f"s{k % 3}", k, f"k{k}", k, 5, "x", "r", 0.5, 3, 0.9, 4, k))
    rows += [rows[25], rows[25], rows[20], rows[0]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def plain_mix(rows):
    """Copies of each row, by loops."""
    size = lambda r: len((r.text or "").encode().split())
    key = lambda r: md5(" ".join(f"{a}{b}" if b is not None else "n" for a, b in (("d", r.doc_id), ("s", r.source), ("t", r.text))).encode()).hexdigest()
    cls = lambda n: n if n < 32 else n.bit_length() * 16 + (n >> (n.bit_length() - 5) & 15)
    sizes = Counter()
    for r in rows:
        sizes[r.source] += size(r)
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    whole, stopped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in stopped]
        unit = (whole - sum(stopped.values())) / sum(weight[s] for s in free)
        over = [s for s in free if unit * weight[s] > 3 * sizes[s]]
        if not over:
            break
        stopped |= {s: 3 * sizes[s] for s in over}
    out = Counter()
    for s in names:
        target = stopped.get(s, unit * weight[s])
        rate = target / sizes[s] if sizes[s] else 0
        u = int(md5(f"mix-1-{'n' if s is None else 's' + s}".encode()).hexdigest()[:8], 16) / 2**32
        mine = sorted((r for r in rows if r.source == s), key=lambda r: (cls(size(r)), key(r)[:3], size(r), r.doc_id is None, r.doc_id or 0, key(r)))
        taken = 0
        for k, r in enumerate(mine, 1):
            n = math.floor(k * rate + u) - math.floor((k - 1) * rate + u)
            out[r.doc_id, r.source, r.text] += n
            taken += n * size(r)
        assert abs(taken - target) <= max(map(size, mine))
    return +out


def test_mix_against_loops(odd):
    want = plain_mix(odd.collect())
    got = mixing.mix_documents(odd)
    assert got.columns == NAMES
    rows = got.collect()
    assert Counter((r.doc_id, r.source, r.text) for r in rows) == want
    assert all(r.key == "x" and r.row == "r" and r["__key"] == f"k{r.copies}" for r in rows)
    assert mixing.mix_documents(odd.limit(0)).count() == 0


@pytest.mark.parametrize("keep, find", [(simhash.keep_one, simhash.near_duplicates), (jaccard.keep_one, jaccard.near_duplicates)])
def test_keep_one_of_each_component(odd, keep, find):
    got = keep(odd)
    assert got.columns == NAMES
    rows = got.collect()
    found = find(odd).collect()
    groups = {}
    for r in found:
        groups.setdefault((r.component_id, r.keep_key), []).append(r.doc_id)
    assert len(rows) == len(groups)
    assert sorted(repr(r.doc_id) for r in rows) == sorted(repr(min((i for i in ids if i is not None), default=None)) for ids in groups.values())
    assert all(r["__key"] == f"k{r.copies}" for r in rows)
    assert keep(odd.limit(0)).count() == 0


def test_every_stage_keeps_odd_columns(spark, odd):
    data = "/root/testdata/sf0.001"
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == NAMES, name
        assert stage(spark, odd.limit(0), data).count() == 0, name
    pieces = corpus_pipeline.pack_bins(spark, docs, data)
    assert sum(r.n_words for r in pieces.collect()) == sum(len((r.text or "").split()) for r in docs.collect())
    assert corpus_pipeline.pack_bins(spark, odd.limit(0), data).count() == 0
