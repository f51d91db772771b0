"""Fingerprint selection and likeness, packing and the suffix sort against plain loops."""

import random

import numpy as np
import pytest

from bibspark.llm import fingerprint, packing, suffix_dedup


def plain_selection(text: bytes, rank):
    n = len(text) - 63
    if n < 1:
        return []
    r = [int(rank[e]) for e in fingerprint.entropies(np.frombuffer(text, np.uint8))]
    if n < 64:
        return [r.index(min(r))]
    points = [0] * n
    for s in range(n - 63):
        stretch = r[s : s + 64]
        points[s + stretch.index(min(stretch))] += 1
    return [k for k, p in enumerate(points) if p >= 16]


def test_selected_windows():
    rng = random.Random(1)
    rank = np.array(rng.sample(range(1001), 1001))
    texts = [bytes(rng.choices(b"abcdefgh ", k=rng.choice((0, 5, 63, 64, 100, 126, 127, 200, 900)))) for _ in range(40)]
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    place, doc = fingerprint.Digests.select(offs, np.frombuffer(b"".join(texts), np.uint8), rank)
    got = sorted(zip(doc.tolist(), (place - offs[doc]).tolist(), strict=True))
    assert got == sorted((k, p) for k, t in enumerate(texts) for p in plain_selection(t, rank))


def plain_likeness(a: str, b: str) -> float:
    x, y = ([(int.from_bytes(row.tobytes(), "big"), int(n)) for row, n in zip(bits, features, strict=True)] for bits, _, features in map(fingerprint.read_digest, (a, b)))
    if not x or not y:
        return float(len(x) == len(y))
    if (len(x), len(x) == len(y) and sum(n for _, n in x)) > (len(y), len(x) == len(y) and sum(n for _, n in y)):
        x, y = y, x
    total = 0.0
    for f, n in x:
        best = 0.0
        for g, _ in y:
            chance = f.bit_count() * g.bit_count() / 2048
            most = min(f.bit_count(), g.bit_count()) - chance
            best = max(best, min(1.0, max(0.0, ((f & g).bit_count() - chance) / max(most, 1e-9))))
        total += best * n
    return total / sum(n for _, n in x)


def test_likeness():
    rng = random.Random(2)
    rank = np.arange(1001)
    base = "".join(rng.choices("abcdefghij klm", k=30_000))
    texts = ["", "short", base, base[:20_000] + "".join(rng.choices("nopqrs", k=9000)), base[9000:], "".join(rng.choices("xyz ", k=12_000)), base[:90]]
    digests = [fingerprint.digest(t, rank) for t in texts]
    for a in digests:
        for b in digests:
            got = fingerprint.likeness(fingerprint.read_digest(a), fingerprint.read_digest(b))
            assert got == pytest.approx(plain_likeness(a, b), abs=2e-6)
    near = lambda i, j: fingerprint.likeness(fingerprint.read_digest(digests[i]), fingerprint.read_digest(digests[j]))
    assert near(2, 2) == 1.0 and near(2, 3) > near(2, 5) + 0.3


def test_best_fit_takes_the_tightest_compatible_bin():
    rng = random.Random(3)
    for _ in range(60):
        pieces = sorted(((rng.randint(0, 40), rng.randint(0, 6), rng.randint(0, 9)) for _ in range(rng.randint(0, 90))), key=lambda p: -p[0])
        bins, want = [], []
        for size, source, cluster in pieces:
            fits = [(b["left"], k) for k, b in enumerate(bins) if b["left"] >= size and b["left"] > 0 and source not in b["sources"] and cluster not in b["clusters"]]
            k = min(fits)[1] if fits else len(bins)
            if not fits:
                bins.append({"left": 40, "sources": set(), "clusters": set()})
            bins[k]["left"] -= size
            bins[k]["sources"].add(source)
            bins[k]["clusters"].add(cluster)
            want.append(k)
        assert packing.best_fit(pieces, 40) == want


def test_the_sort_alone_gives_the_same(spark):
    rng = random.Random(4)
    words = [f"word{k}" for k in range(30)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [say(40) for _ in range(4)]
    rows = [(k, "\n".join([say(rng.randint(0, 30)), rng.choice(passages), say(5)][: rng.randint(1, 3)])) for k in range(80)]
    rows += [(100 + k, rows[k][1]) for k in range(20)] + [(None, rows[3][1]), (200, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    one = sorted(map(repr, suffix_dedup.dedup_strings(docs).collect()))
    assert one == sorted(map(repr, suffix_dedup.dedup_strings(docs, settle_copies=False).collect()))
    assert one == sorted(map(repr, suffix_dedup.dedup_strings(docs, hot_blocks=2).collect()))


def test_hot_anchors_are_cut_by_content():
    rng = np.random.default_rng(7)
    buf = rng.integers(97, 100, 4000).astype(np.uint8)
    buf[2500:3300] = buf[100:900]
    offs = np.array([0, 1500, 4000])
    start, count, rel, key = suffix_dedup.segments(buf, offs, 50)
    of, begin, n, r, both = suffix_dedup.cut_hot(buf, offs, 50, start, count, rel, key)
    windows = {int(s) + k: (int(a), int(s) + int(x)) for s, m, x, a in zip(start, count, rel, key, strict=True) for k in range(m)}
    parts = {int(s) + k: (int(a), int(s) + int(x)) for s, m, x, a in zip(begin, n, r, both, strict=True) for k in range(m)}
    assert windows.keys() == parts.keys() and all(windows[w][1] == parts[w][1] for w in windows) and (r >= 0).all() and len(begin) > len(start)
    by_text = {}
    for w, (k, at) in parts.items():
        assert by_text.setdefault(bytes(buf[w : w + 50]), (k, at - w)) == (k, at - w)


def test_very_long_texts(spark):
    rng = random.Random(5)
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 9) for _ in range(700_000))  # some 4 MB
    docs = spark.createDataFrame([(1, "x y z"), (2, long), (3, "intro " + long)], "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_dedup.dedup_strings(docs).collect()}
    assert got[1].n_removed == 0 and got[3].n_removed >= len(long)
