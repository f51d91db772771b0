"""PII: names over the corpus, and formats beyond those of the test tables."""

import itertools
import random
import time

from bibspark.llm import pii


def test_names_stay_distinct_over_the_corpus():
    letters = "".join(pii.NAME_LETTERS)
    assert len(letters) == len(set(letters)) == len(set(letters.upper())) == len(letters.upper())
    ends = ("son", "mann", "er", "ova")
    people = ["".join(x).capitalize() + e for x in itertools.product("bdfgklmnrst", "aeiou", "lmnrst", "aeiou", "dkt") for e in ends]
    new = [pii.replace(f"Dr {p} came")[0] for p in people]  # a document each
    assert len(set(new)) == len(people) > 19_000
    odd = ["Müller", "Mueller", "Μαρία", "Иванов", "Aб", "Бa", "Anna-Maria Li", "Anna Maria Li"]
    assert len({pii.name(p, g, b"k") for p in odd for g in "mfn"}) == 6 + 3 * 2


def test_a_name_does_not_depend_on_its_document():
    alone = pii.replace("Frau Anna Meier came")[1][0]["surrogate"]
    assert pii.replace("Dr Anna Meier saw Frau Anna Meier")[1][1]["surrogate"] == alone


def test_formats():
    phones = ["+14155552671", "+49 30 12345678", "+49 151 23456789", "+33 6 12 34 56 78", "06 12 34 56 78", "030/1234567", "4155552671", "+1 (017) 555-7713"]
    heads = ("422222222222", "3056930902590", "601100099013942400"[:18], "400000000000000000")
    cards = [h + str(pii.luhn(h)) for h in heads] + ["3056 930902 5904", "4952 9359 0025 3052"]
    addresses = ["2001:db8::8a2e:370:7334", "2a00:1450:4001:81b::200e", "fe80::1", "2A00:1450:4001:081B:0000:0000:0000:200E", "::1", "64:ff9b::1"]
    for kind, group in (("phone", phones), ("card", cards), ("ip", addresses)):
        for old in group:
            new, made = pii.replace(f"see {old}, then go.")
            assert [m["type"] for m in made] == [kind], old
            assert old not in new and new == f"see {made[0]['surrogate']}, then go.", old
            if kind == "card" and old != cards[-1]:
                digits = made[0]["surrogate"].replace(" ", "")
                assert pii.luhn(digits[:-1]) == int(digits[-1])
    one = lambda x: pii.replace(f"see {x}, then")[1][0]["surrogate"]
    digits = lambda x: "".join(ch for ch in x if ch.isdigit())
    assert digits(one("+14155552671")) == digits(one("+1 (415) 555-2671")) and one("+49 30 12345678").startswith("+49 ")
    assert one(addresses[1]) == one(addresses[3]).lower() and one(addresses[0]).startswith("2001:db8:") and one("fe80::1")[:3] in ("fe8", "fe9", "fea", "feb")
    assert len({one(f"2001:db8::{k:x}") for k in range(1, 300)} | {one(f"2a00::{k:x}") for k in range(1, 300)}) == 598
    for clean in ("at 10:20:30 on 2024-05-06", "std::vector a::b", "number 1234567890123", "from 1699999999 to 2019", "ratio 3:2"):
        assert pii.replace(clean) == (clean, []), clean


def test_hundred_thousand_names():
    ends = ("son", "mann", "er", "ova", "ski")
    people = ["".join(x).capitalize() + e for x in itertools.product("bdfgklmnrst", "aeiou", "lmnrstvw", "aeiou", "bdfgklmnt", "io") for e in ends][:100_000:2]
    people += [p[0] + p[1:][::-1] for p in people]
    first = [pii.name(p, "n", b"k") for p in people]
    assert len(set(first)) == len(set(people)) > 75_000
    assert first[::500] == [pii.replace(f"Dr {p} came", b"k")[1][0]["surrogate"] for p in people[::500]]


def test_very_long_texts_and_entities():
    rng = random.Random(4)
    run = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=10_000_000))
    began = time.monotonic()
    assert pii.replace(run) == (run, [])
    assert time.monotonic() - began < 30  # 3 s alone; a quadratic search takes hours
    for text, kind in (("token=" + run[:400_000], "secret"), ("0" * 300_001, "hex"), (run[:300_000] + "@x.com", "email"), ("Dr A" + "b" * 300_000, "name")):
        new, made = pii.replace(text)
        assert [m["type"] for m in made] == [kind] and new != text
    assert len(pii.replace("ab" * 50_000)[0]) == 100_000


def test_long_values_stay_distinct():
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab1", k=200)) for _ in range(300)]
    texts += [t[:k] + ("c" if t[k] != "c" else "d") + t[k + 1 :] for t in texts[:50] for k in (0, 63, 64, 199)]
    assert len({pii.secret(t, b"k") for t in texts}) == len(set(texts))
    assert len({pii.spell("a" * k, b"k") for k in range(60, 140)}) == 80
    small = {"".join(x) for x in itertools.product("ab", repeat=6)}
    old, pii.PERMUTED = pii.PERMUTED, 2  # blocks of two letters: a permutation of all words of six
    try:
        alphabet = ["".join(x) for x in itertools.product("abcdefghijklmnopqrstuvwxyz", repeat=3)]
        assert sorted(pii.permute_classes(x, b"k", b"t") for x in alphabet) == alphabet
        assert len({pii.permute_classes(x, b"k", b"t") for x in small}) == len(small)
    finally:
        pii.PERMUTED = old


def test_operator_on_odd_tables(spark):
    rows = [(1, "Dr Anna Meier", "x", 1), (1, "Dr Anna Meier", "x", 1), (None, None, None, None), (2, "", "y", 2), (3, "call 030/1234567", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, entities string, n_entities int")
    got = pii.replace_texts(docs)
    assert got.schema.names == docs.schema.names and got.count() == 5
    texts = [r.text for r in got.collect()]
    assert texts[0] == texts[1] != rows[0][1] and texts[2] is None and texts[3] == ""
    for r in pii.surrogates(docs).collect():
        assert r.n_entities == len(r.entities) and all(r.text[e.start : e.end] == e.surrogate for e in r.entities)
    assert pii.replace_texts(docs.limit(0)).count() == 0
