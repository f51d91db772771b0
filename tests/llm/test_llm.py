"""The training-data operators against brute force, on small tables with nulls, empty and long
texts, ties, repeated rows, an empty table and extra columns with clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bibspark.llm import common, embedding_dedup, fingerprint, lm_scoring, mixing, packing, pii, simhash, substring_dedup, suffix_dedup, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, component_id long"


def make(spark, n=60, seed=1):
    rng = random.Random(seed)
    words = [f"w{k}é" for k in range(40)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = say(30)
    texts = [say(rng.randint(1, 60)) for _ in range(n)]
    for k in range(0, n, 7):
        texts[k] = texts[k] + "\n" + shared + "\t" + say(5)
    texts[3], texts[4], texts[5], texts[6] = None, "", " \n ", texts[0]
    texts[8] = say(3000)
    rows = [(k, t, "en", None if k % 11 == 0 else f"s{k % 3}", 0, 1.0, 7, -1) for k, t in enumerate(texts)]
    rows += [rows[9], (None, texts[0], None, "s1", None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(r):
    return (r.doc_id is None, r.doc_id or 0)


def brute_windows(rows, split, length):
    least = {}
    for r in rows:
        s = split(r.text or "")
        for k in range(len(s) - length + 1):
            g = tuple(s[k : k + length])
            least[g] = min(least.get(g, key(r)), key(r))
    out = []
    for r in rows:
        s = split(r.text or "")
        gone = [False] * len(s)
        for k in range(len(s) - length + 1):
            if least[tuple(s[k : k + length])] < key(r):
                gone[k : k + length] = [True] * length
        out.append((r.doc_id, len(s), gone, [x for x, g in zip(s, gone, strict=True) if not g]))
    return out


def test_substring(docs, empty):
    want = [(i, n, sum(g), hashlib.sha256(b" ".join(kept)).hexdigest()) for i, n, g, kept in brute_windows(docs.collect(), lambda t: t.encode().split(), 13)]
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup_windows(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert substring_dedup.dedup_windows(empty).count() == 0


def test_suffix(docs, empty):
    runs = lambda g: sum(1 for k, x in enumerate(g) if x and (not k or not g[k - 1]))
    want = [(i, n, sum(g), runs(g), hashlib.sha256(bytes(kept)).hexdigest()) for i, n, g, kept in brute_windows(docs.collect(), lambda t: list(t.encode()), 50)]
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.dedup_strings(docs).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert suffix_dedup.dedup_strings(empty).count() == 0


def test_suffix_sort_orders_and_survives_collisions(monkeypatch):
    rng = np.random.default_rng(0)
    buf = rng.integers(97, 99, 400).astype(np.uint8)
    buf[200:300] = buf[:100]
    pos = np.arange(350)
    ids = (pos >= 200).astype(np.int64)
    group = np.zeros(350, np.uint64)
    want = [i == 1 and bytes(buf[p : p + 50]) in {bytes(buf[q : q + 50]) for q in range(200)} for p, i in zip(pos, ids, strict=True)]
    assert suffix_dedup.repeated(buf, pos, group, ids, 50).tolist() == want
    s = suffix_dedup.Suffixes(buf, 50, common.BASES[0])
    order = suffix_dedup.merge_sort(s, pos, ids, np.array([0]), np.array([350]))
    keys = [(bytes(buf[p : p + 50]), ids[p]) for p in pos[order]]
    assert keys == sorted(keys)
    monkeypatch.setattr(common, "BASES", (1, 1, 1, 1))  # every permutation of bytes collides
    assert suffix_dedup.repeated(buf, pos, group, ids, 50).tolist() == want


def test_simhash(docs, empty):
    rows = docs.collect()

    def fp(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    fps = [fp(r.text) for r in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 2:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[k].doc_id for k in range(len(rows)) if group[k] == g and rows[k].doc_id is not None), default=None) for g in group}
    want = sorted((repr(r.doc_id), fps[k], least[group[k]]) for k, r in enumerate(rows))
    got = sorted((repr(r.doc_id), r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert simhash.near_duplicates(empty).count() == 0 and simhash.keep_one(empty).count() == 0


def test_pigeonring_finds_all_pairs(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for x in base:
        for bits in (1, 2, 2, 3):
            y = x
            for b in rng.sample(range(64), bits):
                y ^= 1 << b
            fps.add(y)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    got = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (1 << 64) - 1).count("1") <= 2}


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 200), (200, 300), (7, 7)]
    got = dict(common.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{k: 0 for k in range(31)}, 100: 100, 200: 100, 300: 100}


def test_embeddings(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 16))
    for k in range(1, 300, 3):
        x[k] = x[k - 1] + rng.normal(size=16) * 0.1
    rows = [(k, v.tolist(), "x") for k, v in enumerate(x)] + [(300, x[0].tolist(), ""), (301, None, ""), (302, [0.0] * 16, ""), (303, [float("nan")] * 16, ""), (304, [1.0, 2.0], ""), (305, [], "")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n_links string")
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(df).collect()}
    u = np.vstack([x, x[:1]])
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    n = [got[k].n_links for k in range(301)]
    assert sum(n) >= 0.9 * near.sum() and all(a <= b for a, b in zip(n, near.sum(axis=1), strict=True))
    assert got[300].component_id == 0 and not got[300].kept
    assert all(got[k].n_links == 0 and got[k].component_id == k for k in range(301, 306))
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_lm(docs, empty):
    rows = docs.collect()
    held = lambda r: r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2
    tokens = [t for r in rows if not held(r) for t in [*(r.text or "").lower().encode().split(), b"<end>"]]
    got = lm_scoring.score_documents(docs).collect()
    n, v = len(tokens), len(set(tokens))
    assert {r.train_tokens for r in got} == {n} and len(got) == len(rows)
    base = lambda text: sum(np.log10((tokens.count(t) + 1) / (n + v + 1)) for t in [*(text or "").lower().encode().split(), b"<end>"])
    want = sorted((repr(r.doc_id), held(r), round(base(r.text), 6)) for r in rows)
    assert sorted((repr(r.doc_id), r.held_out, round(r.base_score, 6)) for r in got) == want
    assert lm_scoring.score_documents(empty).count() == 0


def test_lm_beats_base_on_repeated_phrases(docs):
    got = lm_scoring.score_documents(docs).collect()
    assert sum(r.score for r in got) > sum(r.base_score for r in got) and all(r.score < 0 for r in got)


def test_mixing(docs, empty):
    sized = mixing.sizes(docs)
    got = mixing.mix(sized).collect()
    assert len(got) == docs.count() and all(0 <= r.copies <= 3 and r.taken == r.copies * r.size for r in got)
    size, taken, target = {}, {}, {}
    for r in got:
        size[r.source], taken[r.source], target[r.source] = r.source_size, taken.get(r.source, 0) + r.taken, r.target
    whole, names = sum(size.values()), sorted(size, key=lambda s: (s is None, s))
    weight, free, want = dict(zip(names, (5.0, 2.0, 1.0, 5.0), strict=True)), set(names), {}
    while True:
        rest = whole - sum(want.values())
        over = {s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * size[s]}
        if not over:
            break
        want |= {s: 3.0 * size[s] for s in over}
        free -= over
    want |= {s: (whole - sum(3.0 * size[x] for x in names if x not in free)) * weight[s] / sum(weight[x] for x in free) for s in free}
    assert all(abs(target[s] - want[s]) < 1e-6 * whole for s in names)
    again = {repr(r) for r in mixing.mix(sized).collect()}
    assert again == {repr(r) for r in got}
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(mixing.sizes(empty)).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, capacity=100).collect()
    bins = {}
    for r in rows:
        bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        assert sum(r.n_words for r in b) <= 100 and len({r.source for r in b}) == len(b) and len({r.cluster for r in b}) == len(b)
    assert sum(r.n_words for r in rows) == sum(len((r.text or "").split()) for r in docs.collect())
    assert packing.best_fit([(6, "a", 1), (5, "b", 2), (4, "c", 3), (4, "a", 4), (1, "d", 5)], 10) == [0, 1, 0, 1, 1]
    assert packing.pack(empty).count() == 0


def test_pii(spark, docs, empty):
    text = "Mail Ann.Lee@mail3.example.com, +1 (017) 555-7713, 4952 9359 0025 3052, 10.1.2.3; Frau Meier met Herr Meier. token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" Mail ann.lee@mail3.example.com"
    new, made = pii.replace(text)
    assert [m["type"] for m in made] == ["email", "phone", "card", "ip", "name", "name", "secret", "email"]
    assert all(new[m["start"] : m["end"]] == m["surrogate"] for m in made) and made[0]["surrogate"].lower() == made[7]["surrogate"]
    assert made[4]["surrogate"] == made[5]["surrogate"] and made[3]["surrogate"].startswith("10.") and made[1]["surrogate"].startswith("+1 (")
    assert not any(x in new for x in ("555-7713", "4952 9359", "04dbebab", "Meier", "Ann.Lee"))
    new, made = pii.replace("SSN 123-45-6789, account DE89 3704 0044 0532 0130 00 or GB82WEST12345698765432; AB12 is none")
    assert [m["type"] for m in made] == ["ssn", "iban", "iban"] and "AB12 is none" in new and "123-45-6789" not in new
    valid = lambda x: int("".join(str(int(ch, 36)) for ch in x[4:] + x[:4])) % 97 == 1
    a, b = (m["surrogate"] for m in made[1:])
    assert a[:2] == "DE" and [k for k, ch in enumerate(a) if ch == " "] == [4, 9, 14, 19, 24] and valid(a.replace(" ", "")) and b[:2] == "GB" and b[4:8].isalpha() and valid(b)
    assert sorted(pii.permute(x, 1000, b"k", b"t") for x in range(1000)) == list(range(1000))
    assert all(pii.permute(x, 1000, b"k", b"t") != x for x in range(1000))
    assert len({pii.ip(f"192.168.{a}.{b}", b"k") for a in range(4) for b in range(200)}) == 800
    clean = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.text == clean[r.doc_id] and r.n_entities == 0 for r in pii.surrogates(docs.where("doc_id is not null")).collect())
    assert pii.replace_texts(docs).columns == docs.columns and pii.surrogates(empty).count() == 0


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(300):
        bad = k % 4 == 0
        words = [f"u{rng.randint(0, 80)}" for _ in range(30)]
        words = ["".join("abcdefghij"[int(ch)] if ch.isdigit() else ch for ch in w) for w in words]
        if bad:
            words[rng.randint(5, 25)] = "grubnik" + rng.choice("xyz")
        rows.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(d, y)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    assert all((got[k] >= 0.5) == bool(t) for k, t in labels)
    out = toxicity.score(docs, model)
    assert out.columns[-1] == "score" and all(0 <= r.score < 0.5 for r in out.collect())
    assert toxicity.accept(docs, model).count() == docs.count() and toxicity.score(empty, model).count() == 0


def test_fingerprint(docs, empty):
    rng = np.random.default_rng(1)
    buf = rng.integers(97, 105, 300).astype(np.uint8)
    want = []
    for k in range(300 - 63):
        n = np.bincount(buf[k : k + 64])
        p = n[n > 0] / 64
        want.append(-(p * np.log2(p)).sum() / 6 * 1000)
    assert np.abs(fingerprint.entropies(buf) - want).max() <= 1
    rows = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).orderBy(F.desc("doc_id")).collect()
    got = {r.doc_id: r for r in fingerprint.fingerprints(docs.where("doc_id is not null").dropDuplicates(["doc_id"])).collect()}
    for k, r in enumerate(rows):
        edited = fingerprint.edit(r.text or "", rows[(k + 1) % len(rows)].text or "")
        assert got[r.doc_id].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and 0 <= got[r.doc_id].near_edited <= 1
    assert got[0].fingerprint == got[6].fingerprint
    assert fingerprint.likeness(fingerprint.read_digest(got[8].fingerprint), fingerprint.read_digest(got[8].fingerprint)) == 1.0
    assert fingerprint.fingerprints(docs).count() == docs.count() and fingerprint.fingerprints(empty).count() == 0
