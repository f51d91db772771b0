"""The clause grammar against a plain reading of its rules, and the model's independence of partitions."""

import random

from bibspark.llm import toxicity as t

TAGS = ("insult", "harm", "target", "negation", "report", "modal", "other", "quote")


def plain_readings(tags, quoted=False):
    """What each tag reads as, by looking around it."""
    n, out = len(tags), []
    within = lambda k, name: any(tags[j] == name for j in range(max(0, k - t.REACH), k))
    is_threat = []
    for k, s in enumerate(tags):  # a modal serves one harm verb
        last = max((j for j in range(k) if tags[j] == "modal" or is_threat[j]), default=None)
        is_threat.append(s == "harm" and last is not None and tags[last] == "modal" and k - last <= t.REACH)
    for k, s in enumerate(tags):
        if s != "insult" and not is_threat[k]:
            out.append(None)
            continue
        kind = "insult" if s == "insult" else "threat"
        told, marks = False, quoted
        for j in range(k):
            if tags[j] == "quote":
                marks, told = not marks, False
            elif tags[j] == "report" and not marks:
                told = True
        if within(k, "negation"):
            out.append((kind, "denied"))
        elif told or marks:
            out.append((kind, "reported"))
        else:
            aimed = within(k, "target") or any(tags[j] == "target" for j in range(k + 1, min(n, k + t.REACH + 1)))
            beside = any(tags[j] != "quote" for j in range(n) if j != k)
            if kind == "threat":
                out.append((kind, "aimed" if aimed else "plain"))
            else:
                out.append((kind, ("aimed" if aimed else "stated") if beside else "word"))
    return out


def test_machine_reads_as_the_rules_say():
    rng = random.Random(8)
    machine = t.Grammar()
    for _ in range(4000):
        tags = [rng.choice(TAGS) for _ in range(rng.randint(1, 12))]
        quoted = rng.random() < 0.2
        read, weights = machine.read(tags, "quoted" if quoted else "direct")
        want = plain_readings(tags, quoted)
        assert [s if isinstance(s, tuple) else None for s in read] == want, tags
        arcs = [r for w in want if w for r in {("insult", "stated"): ["stated"], ("insult", "aimed"): ["stated", "aimed"], ("threat", "aimed"): ["threat"]}.get(w, [w[1]] if w[1] in ("denied", "reported") else [])]
        assert sorted(weights) == sorted(arcs)


def labelled(spark, n, partitions, words=("grubnik", "plodder", "snarfle", "wimbort")):
    rng = random.Random(2)
    rows, labels = [], []
    for k in range(n):
        text = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(25)]
        if k % 4 == 0:
            text[rng.randint(5, 20)] = rng.choice(words)
        rows.append((k, " ".join(text)))
        labels.append((k, int(k % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions), spark.createDataFrame(labels, "doc_id long, toxic int").repartition(partitions)


def test_one_model_whatever_the_partitions(spark):
    one = t.fit(*labelled(spark, 1200, 1))
    assert one == t.fit(*labelled(spark, 1200, 16))
    assert one.lexicon == {"=grubnik", "=plodder", "=snarfle", "=wimbort"}
    score = lambda x: one.scores([x])[0]
    assert score("abc grubnik cab") >= 0.5 and score("you are a grubnik") >= score("abc grubnik cab")
    for text in ("grubnik", "Grubnik!", "you are not grubnik", 'he said "grubnik"', "he said you are a grubnik", '"You are dull. You are a grubnik."', "grubniks abc", "grumpy gruyere", "", None):
        assert score(text) < 0.5, text


def test_beginnings_need_several_words_and_are_as_long_as_they_can_be(spark):
    model = t.fit(*labelled(spark, 1600, 4, [f"zorvel{x}" for x in ("a", "bu", "cat", "dim", "en", "fog", "gi", "hut", "is", "jot", "ka", "lo")]))
    assert model.lexicon == {"zorvel"}
    assert t.choose_entries({"gru": (20, 1), "=grubnik": (20, 1), "grub": (20, 1)}) == {"=grubnik"}


def test_no_toxic_rows(spark):
    d, y = labelled(spark, 60, 2)
    model = t.fit(d, y.selectExpr("doc_id", "0 as toxic"))
    assert not model.lexicon and model.scores(["abc", None, "i will kill you"])[0] < 0.5
    assert t.accept(d.selectExpr("doc_id", "text", "1 as score", "2 as `SCORE x`"), model).columns == ["doc_id", "text", "score", "SCORE x"]
    assert t.accept(d.limit(0), model).count() == 0


def test_long_texts():
    model = t.Model(frozenset({"=grubnik"}), t.PRIOR.tolist())
    long = "so it is, " * 300_000
    assert model.scores([long + "you are a grubnik"]) == model.scores(["you are a grubnik"])
    assert model.scores(["\"" + "x " * 1_000_000])[0] < 0.5
