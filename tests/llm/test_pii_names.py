"""Names, their later mentions and e-mail addresses: texts put together from parts whose replacement is
known, and the properties of surrogates."""

import itertools
import random
import re

import pytest

from bibspark.llm import pii
from bibspark.llm.pii import KEY, name_parts, part_surrogate, replace, spell


def word(w: str, given: bool = False, gender: str = "m") -> str:
    return part_surrogate(w, given, gender, KEY)


def test_addresses_keep_their_at():
    for s in ("jose@example.com", "a.b@example.org", "x@host.example.net", "Q.w@Foo.co.uk", "a@b.de"):
        new, made = replace(f"write to {s} now")
        got = made[0]["surrogate"]
        assert new == f"write to {got} now" and got != s and len(got) == len(s)
        assert [c if c in "@." else "x" for c in got] == [c if c in "@." else "x" for c in s]
        assert got.rpartition(".")[2] == s.rpartition(".")[2]
    assert replace("jose@example.com")[0].endswith("@example.com")
    assert replace("jose@mail.example.com")[0].endswith(".example.com") and "@mail" not in replace("jose@mail.example.com")[0]


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("Mr McDonald", ["McDonald"]), ("Mrs LeBlanc", ["LeBlanc"]), ("Mrs Van der Berg", ["Berg"]), ("Mr O'Brien", ["O'Brien"]), ("Mr O’Brien", ["O’Brien"]), ("Mr de la Cruz", ["Cruz"]),
        ("Mr SMITH", ["SMITH"]), ("Herr Müller-Lüdenscheidt", ["Müller-Lüdenscheidt"]), ("Monsieur D'Angelo", ["D'Angelo"]), ("Mr Čapek", ["Čapek"]), ("господин Иванов", ["Иванов"]), ("κύριος Παπαδόπουλος", ["Παπαδόπουλος"]),
        ("Mr Smith's", ["Smith"]), ("Frau von der Leyen", ["Leyen"]),
    ],
)
def test_whole_names(text, parts):
    new, made = replace(f"so {text} came")
    assert len(made) == 1
    want = text
    for p in parts:
        got = re.sub(r"[^\w'’-]", "", word(p))
        assert len(got) == len(p) and got != p and pii.script(got) == pii.script(p)
        assert [c.isupper() for c in got] == [c.isupper() for c in p]
        assert [c if c in "'’-" else "x" for c in got] == [c if c in "'’-" else "x" for c in p]
        want = want.replace(p, got)
    assert new == f"so {want} came"


def test_later_mentions_get_the_same_surrogate():
    smith = word("Smith")
    assert replace("Mr Smith came. Smith left. John Smith said so.")[0] == f"Mr {smith} came. {smith} left. John {smith} said so."
    assert replace("SMITH and smith, Smithson, Smith-Jones; Mr Smith's and Smith's.")[0] == f"{smith.upper()} and smith, Smithson, Smith-Jones; Mr {smith}'s and {smith}'s."
    anna = word("Anna", True, "f")
    assert replace("Frau Anna Schmidt sah sich. Anna ging. Schmidt auch.")[0] == f"Frau {anna} {word('Schmidt')} sah sich. {anna} ging. {word('Schmidt')} auch."
    assert replace("Dr Li and Li")[0] == f"Dr {word('Li')} and Li"  # two letters alone are no mention
    assert replace("Smith left.") == ("Smith left.", [])


def test_surrogates_are_a_permutation():
    for letters, n in (("abce", 5), ("aäbß", 4), ("аби", 4)):
        words = ["".join(x) for x in itertools.product(letters, repeat=n)]
        new = [spell(w, KEY) for w in words]
        assert len(set(new)) == len(words) and all(a != b for a, b in zip(words, new, strict=True) if set(a) != {"ß"})
    shape = "cvcvc"
    all_of = ["".join(x) for x in itertools.product("bc", "ae", "b", "ae", "d")]
    assert all([("v" if c in "aeiou" else "c") for c in spell(w, KEY)] == list(shape) for w in all_of)
    assert spell("smith", KEY) != spell("smith", b"other")
    assert name_parts("J. R. de la Cruz") == [("J", True), ("R", True), ("Cruz", False)]


def test_texts_from_known_parts():
    """Detection and replacement against a text that is put together piece by piece."""
    r = random.Random(4)
    families = ["Smith", "McDonald", "O'Brien", "Müller-Lüdenscheidt", "Cruz", "SMITH", "Nowak"]
    filler = ["so they say", "the house", "and then nothing", "in 1999 or so", "a token of it", "key words", "no one"]
    made_of = {"Mr": "m", "Mrs": "f", "Dr": "n"}
    for _ in range(200):
        old, want, known = [], [], {}
        for _ in range(r.randrange(1, 12)):
            kind = r.randrange(5)
            if kind == 0:
                title, family = r.choice(list(made_of)), r.choice(families)
                particle = r.choice(["", "de la ", "von "])
                old.append(f"{title} {particle}{family}")
                want.append(f"{title} {particle}{word(family)}")
                known[family.lower()] = True
            elif kind == 1:
                mail = f"{r.choice(['jo', 'an.b', 'x-y'])}@{r.choice(['example.com', 'mail.example.org', 'firm.de'])}"
                old.append(mail)
                want.append(pii.email(mail, KEY))
            elif kind == 2:
                ip = f"10.{r.randrange(256)}.{r.randrange(256)}.7"
                old.append(ip)
                want.append(pii.ip(ip, KEY))
            elif kind == 3:
                family = r.choice(families)
                old.append(family)
                want.append((family,))
            else:
                old.append(r.choice(filler))
                want.append(old[-1])
        want = [w if isinstance(w, str) else (word(w[0]) if w[0].lower() in known else w[0]) for w in want]
        assert replace(" , ".join(old))[0] == " , ".join(want)


def test_many_mentions_take_linear_time(spark):
    text = "Mr Smith and Smith met Mrs Van der Berg. " * 50_000
    docs = spark.createDataFrame([(1, text), (None, None), (2, ""), (2, "")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.surrogates(docs).collect()}
    assert got[1].n_entities == 150_000 and "Smith" not in got[1].text and "Berg" not in got[1].text
    assert got[None].text is None and got[2].text == ""
