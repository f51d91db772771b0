"""The pipeline end to end on the smallest tables, each stage against plain loops over its input."""

from collections import Counter

import corpus_pipeline
from bibspark.llm import pii, toxicity
from bibspark.llm.common import materialize
from test_stages import plain_mix

DATA = "/root/testdata/sf0.001"


def plain_near_dedup(rows):
    """doc_ids that stay: the least of each component of texts with 5-word Jaccard 0.8 or more."""
    sets = []
    for r in rows:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    group = list(range(len(rows)))
    for a, x in enumerate(sets):
        for b in range(a):
            if len(x & sets[b]) / len(x | sets[b]) >= 0.8:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return {min(rows[k].doc_id for k in range(len(rows)) if group[k] == g) for g in set(group)}


def test_stages_against_loops(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:4]:
        rows = docs.collect()
        out = materialize(stage(spark, docs, DATA))
        assert out.schema == docs.schema, name
        got = out.collect()
        if name == "toxicity":
            scores = toxicity.fit(docs, labels).scores([r.text for r in rows])
            assert Counter(got) == Counter(r for r, s in zip(rows, scores, strict=True) if s < 0.5) and len(got) > 0.7 * len(rows)
        elif name == "simhash_near_dedup":
            ids = plain_near_dedup(rows)
            assert Counter(got) == Counter(r for r in rows if r.doc_id in ids) and len(got) < len(rows)
        elif name == "pii":
            assert Counter((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in got) == Counter((r.doc_id, pii.replace(r.text)[0], r.lang, r.source, r.n_chars) for r in rows)
        else:
            assert Counter((r.doc_id, r.source, r.text) for r in got) == plain_mix(rows)
        docs = out
    bins = {}
    rows = corpus_pipeline.pack_bins(spark, docs, DATA).collect()
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        assert sum(r.n_words for r in b) <= 1024 and len({r.source for r in b}) == len(b) and len({r.cluster for r in b}) == len(b)
    assert Counter({i: n for i, n in words_of((r.doc_id, r.n_words) for r in rows).items() if n}) == +words_of((r.doc_id, len((r.text or "").encode().split())) for r in docs.collect())


def words_of(pairs):
    out = Counter()
    for i, n in pairs:
        out[i] += n
    return out


def test_run_equals_its_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA))
    assert Counter(corpus_pipeline.run(spark, DATA).collect()) == Counter(docs.collect())
