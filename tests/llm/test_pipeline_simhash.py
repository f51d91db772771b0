"""The pipeline's near-dedup stage drops what SimHash links and what Jaccard links."""

import corpus_pipeline
from bibspark.llm import simhash


def test_stage_takes_both_kinds_of_links(spark):
    words = lambda k, n: " ".join(f"w{k}x{j}" for j in range(n))
    same = "x y z " * 200  # outweighs the tails in a fingerprint, but is three shingles
    long = words(9, 60)
    texts = {1: same + words(1, 10), 2: same + words(2, 10), 3: long, 4: long + " " + words(4, 8), 5: words(5, 40), 6: words(6, 40), 7: None, 8: ""}
    a, b, x, y = (simhash.fingerprint(texts[k].encode()) for k in (1, 2, 3, 4))
    assert bin(a ^ b).count("1") <= 2 < bin(x ^ y).count("1")
    docs = spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert out.schema == docs.schema and sorted(r.doc_id for r in out.collect()) == [1, 3, 5, 6, 7]
