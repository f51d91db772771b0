"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words become tags: insult (a lexicon of words and word beginnings learned from labels), harm verb,
modal, target (you, they and the like), negation, report (said, wrote and the like), quotation
mark, other. Transducers read a clause's tags from the left, then what they wrote from the right;
their composition gives each harmful tag a reading:

    threat      modal ... harm                                        -> threat
    insult      an insult with another word of the clause beside it   -> stated (else it stays a mere word)
    target      a harmful tag within REACH of a target, on any side   -> aimed
    negation    a harmful tag within REACH after a negation           -> denied
    reported    a harmful tag after a report or in quotation marks    -> reported

Arcs carry weights, learned by logistic regression from labelled rows: a stated insult, what aiming
adds to it, an aimed threat; the arcs of denied and reported readings weigh nothing or less. A
document's score is the logistic of the weights of its clauses' paths (the logarithm of one and
their number) and of the number of different stated insults. A word that no pattern matches does
not count: alone, denied or quoted it leaves the score where it is, or lower.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bibspark.llm.common import materialize

#: Labelled rows that a model is fitted on at most: those of the least hash of doc_id.
TRAIN_ROWS = 20_000
#: Lengths of word beginnings tried for the lexicon.
PREFIXES = (3, 4, 5, 6, 7)
#: A lexicon entry occurs in toxic rows after at least MIN_SUPPORT different words (or SHARE of the
#: toxic rows, if more), so that copies of one text count once; PRECISION of its rows are toxic. A
#: beginning is that of at least MIN_WORDS different words, and no longer one does for SAME of its rows.
MIN_SUPPORT, SHARE, PRECISION, MIN_WORDS, SAME = 5, 0.005, 0.95, 4, 0.9
REACH = 4

# fixed values: function words of the grammar
TARGET = frozenset("you your yours u they them their he she him her those these people du dich dir dein euch ihr sie ihm tu te toi ton ta vous votre ils elles eux usted ustedes vosotros ellos ellas él ella".split())
NEGATION = frozenset("not no never isn't don't doesn't aren't wasn't without nor nicht kein keine keinen nie niemals pas ne jamais sans aucun nunca jamás sin ni ningún".split())
REPORT = frozenset("said says say wrote writes called claims claimed quoted quote reported sagte sagt schrieb nannte behauptet dit disait écrit appelé dijo dice escribió llamó".split())
MODAL = frozenset("will shall gonna going must should werde wird soll vais va doit voy vamos debe".split())
HARM = frozenset("kill hurt destroy shoot stab beat burn murder hang töten umbringen schlagen tuer frapper brûler matar golpear quemar".split())
QUOTES = frozenset('"“”„«»')

TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[\"“”„«»]")
CLAUSE_END = ".!?;:\n"
CLAUSE_STOP = re.compile(f"[{CLAUSE_END}]")
#: Weights of arcs, and the bounds and prior of each: those that speak for toxicity are not negative,
#: those of denied and reported readings not positive.
ARCS = ("stated", "aimed", "threat", "denied", "reported")
PARAMETERS = ("bias", *ARCS, "different")
PRIOR = np.array([-4.0, 3.0, 2.0, 8.0, 0.0, 0.0, 1.0])
LOWEST = np.array([-math.inf, 0.0, 0.0, 0.0, -math.inf, -math.inf, 0.0])
HIGHEST = np.array([math.inf, math.inf, math.inf, math.inf, 0.0, 0.0, math.inf])


# ---------------------------------------------------------------- transducers
@dataclass
class Transducer:
    """Deterministic weighted finite-state transducer. arcs: (state, symbol) -> (output, next
    state, weight); a missing arc copies the symbol, weighs nothing and takes `drift[state]` (the
    same state by default). A weight is the name of a parameter, or None."""

    start: object
    arcs: dict = field(default_factory=dict)
    drift: dict = field(default_factory=dict)

    def step(self, state, symbol):
        if (state, symbol) in self.arcs:
            return self.arcs[state, symbol]
        return symbol, self.drift.get(state, state), None


class Composed:
    """Cascade: each transducer reads what the one before wrote; weights add up."""

    def __init__(self, *parts: Transducer):
        self.parts = parts
        self.known: dict = {}

    def step(self, state, symbol):
        key = (state, symbol)
        if key not in self.known:
            after, weights = [], []
            for part, s in zip(self.parts, state, strict=True):
                symbol, s, weight = part.step(s, symbol)
                after.append(s)
                weights += [weight] if weight else []
            self.known[key] = (symbol, tuple(after), tuple(weights))
        return self.known[key]

    def run(self, symbols, **start):
        """Outputs and the weights of the path's arcs. start: states other than the usual by number (s0, s1 ...)."""
        state, out, weights = tuple(start.get(f"s{k}", p.start) for k, p in enumerate(self.parts)), [], []
        for s in symbols:
            written, state, more = self.step(state, s)
            out.append(written)
            weights += more
        return out, weights


def near(trigger: str, rewrite: dict) -> Transducer:
    """Rewrites symbols that follow a trigger within REACH."""
    t = Transducer(0, drift={k: k - 1 for k in range(1, REACH + 1)})
    for k in range(REACH + 1):
        t.arcs[k, trigger] = (trigger, REACH, None)
        for s, new in rewrite.items():
            if k:
                t.arcs[k, s] = (new, k - 1, None)
    return t


WORDS = ("insult", "harm", "target", "negation", "report", "modal", "other")
AIM = {("insult", "word"): ("insult", "aimed word"), ("insult", "stated"): ("insult", "aimed"), ("threat", "plain"): ("threat", "aimed")}
HARMFUL = (*AIM, *AIM.values())


def forward() -> Composed:
    """From the left. Harmful symbols are pairs (kind, reading); an insult that opens its clause is
    a word until the right side says more."""
    threat = Transducer(0, drift={k: k - 1 for k in range(1, REACH + 1)})
    for k in range(REACH + 1):
        threat.arcs[k, "modal"] = ("modal", REACH, None)
        threat.arcs[k, "harm"] = (("threat", "plain") if k else "harm", 0, None)
    stated = Transducer("open", {("open", "insult"): (("insult", "word"), "within", None), ("within", "insult"): (("insult", "stated"), "within", None)})
    for w in (*WORDS[1:], ("threat", "plain")):
        stated.arcs["open", w] = (w, "within", None)
    negation = near("negation", {s: (s[0], "denied") for s in HARMFUL})
    reported = Transducer("direct", {("direct", "report"): ("report", "told", None), ("direct", "quote"): ("quote", "quoted", None), ("told", "quote"): ("quote", "quoted", None), ("quoted", "quote"): ("quote", "direct", None)})
    for state in ("told", "quoted"):
        for s in HARMFUL:
            reported.arcs[state, s] = ((s[0], "reported"), state, None)
    return Composed(threat, stated, near("target", AIM), negation, reported)


#: The place of `reported` in the cascade: its state outlives a clause.
SPEECH = "s4"


def backward() -> Composed:
    """From the right over what forward() wrote: words beside, targets behind; then the weights."""
    stated = Transducer("open")
    for w in (*WORDS, *HARMFUL, *((k, r) for k in ("insult", "threat") for r in ("denied", "reported"))):
        stated.arcs["open", w] = (w, "within", None)
    for k in ("word", "aimed word"):
        stated.arcs["within", ("insult", k)] = (("insult", "aimed" if "aimed" in k else "stated"), "within", None)
    weigh = Transducer(0)
    for name in ("denied", "reported"):
        for kind in ("insult", "threat"):
            weigh.arcs[0, (kind, name)] = ((kind, name), 0, name)
    weigh.arcs[0, ("insult", "stated")] = (("insult", "stated"), 0, "stated")
    weigh.arcs[0, ("threat", "aimed")] = (("threat", "aimed"), 0, "threat")
    # an aimed insult is a stated one and more
    weigh.arcs[0, ("insult", "aimed")] = (("insult", "aimed"), 0, "stated")
    aim = Transducer(0, {(0, ("insult", "aimed")): (("insult", "aimed"), 0, "aimed")})
    return Composed(stated, near("target", AIM), weigh, aim)


class Grammar:
    def __init__(self):
        self.left, self.right = forward(), backward()

    def read(self, tags: list[str], speech: str = "direct"):
        """The readings of a clause's tags, and the weights of their arcs. speech: "quoted" if the
        clause begins inside quotation marks."""
        out, _ = self.left.run(tags, **{SPEECH: speech})
        out, weights = self.right.run(reversed(out))
        return out[::-1], weights


# ---------------------------------------------------------------- matching
def stems(word: str):
    """The word itself (marked) and its beginnings."""
    yield f"={word}"
    for k in PREFIXES:
        if len(word) >= k:
            yield word[:k]


def tag(word: str, lexicon: frozenset) -> tuple[str, str]:
    """Tag of a lower-case token, and the lexicon entry it met."""
    if word in QUOTES:
        return "quote", ""
    for s in stems(word):
        if s in lexicon:
            return "insult", s
    for name, words in (("harm", HARM), ("target", TARGET), ("negation", NEGATION), ("report", REPORT), ("modal", MODAL)):
        if word in words:
            return name, ""
    return "other", ""


def trigger_pattern(lexicon: frozenset) -> re.Pattern:
    """Finds words that make a clause worth reading, letter by letter as in a tree, so that the
    lexicon's size does not matter."""
    tree: dict = {}
    for entry in sorted(lexicon | {f"={w}" for w in HARM}):
        node = tree
        for ch in entry.removeprefix("="):
            node = node.setdefault(ch, {})
        node["=" if entry.startswith("=") else "*"] = {}

    def write(node: dict) -> str:
        if "*" in node:
            return ""
        ways = [re.escape(ch) + write(node[ch]) for ch in node if ch != "="]
        if "=" in node:
            ways.append(r"(?![^\W\d_])")
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return re.compile(r"(?<![^\W\d_])" + write(tree))


def measure(text: str | None, lexicon: frozenset, trigger: re.Pattern, machine: Grammar) -> np.ndarray:
    """log(1 + n) of the weights on the paths of a text's clauses and of its different stated insults."""
    counts = dict.fromkeys(ARCS, 0)
    different: set[str] = set()
    low = (text or "").lower()
    at, line = 0, 0  # read up to here; where the line begins
    quoted = False
    while m := trigger.search(low, at):
        begin = max(low.rfind(ch, at, m.start()) for ch in CLAUSE_END) + 1 or at
        fresh = low.rfind("\n", at, begin)
        if fresh >= 0:  # quotation marks do not reach over lines
            quoted, line = False, fresh + 1
        quoted ^= sum(low.count(q, max(at, line), begin) for q in QUOTES) % 2 == 1
        stop = CLAUSE_STOP.search(low, m.end())
        end = stop.start() if stop else len(low)
        words = TOKEN.findall(low, begin, end)
        met = [tag(w, lexicon) for w in words]
        read, weights = machine.read([t for t, _ in met], "quoted" if quoted else "direct")
        for w in weights:
            counts[w] += 1
        different.update(entry for (_, entry), s in zip(met, read, strict=True) if entry and s[1] in ("stated", "aimed"))
        quoted ^= sum(t == "quote" for t, _ in met) % 2 == 1
        at = max(end, m.end())
    return np.log1p(np.array([*counts.values(), len(different)], float))


# ---------------------------------------------------------------- learning
@dataclass
class Model:
    lexicon: frozenset
    weights: list[float]  # as PARAMETERS

    def scores(self, texts: list[str | None]) -> list[float]:
        trigger, machine = trigger_pattern(self.lexicon), Grammar()
        w = np.array(self.weights)
        out = []
        for t in texts:
            z = float(w[0] + measure(t, self.lexicon, trigger, machine) @ w[1:])
            out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
        return out


def training_rows(docs: DataFrame, labels: DataFrame, folds: int = 5, limit: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most `limit` labelled rows whose crc32(doc_id) mod folds is not 0. The
    bound holds for what is broadcast and fitted, not for what is scored."""
    key = F.col("doc_id").cast("string")
    picked = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .where(F.pmod(F.crc32(key.cast("binary")), F.lit(folds)) != 0)
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    )
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("text", "toxic")


def fit_lexicon(rows: DataFrame) -> frozenset:
    """Words and word beginnings of toxic rows that other rows hardly have. All figures are exact
    counts over the rows; how they lie in partitions does not matter."""

    def count_rows(batches):
        for batch in batches:
            hits: tuple[dict[str, int], dict[str, int]] = ({}, {})
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = hits[toxic]
                for s in {s for w in set(TOKEN.findall((text or "").lower())) for s in stems(w)}:
                    n[s] = n.get(s, 0) + 1
            every = [*hits[1], *(s for s in hits[0] if s not in hits[1])]
            yield pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *[pa.array([h.get(s, 0) for s in every], pa.int64()) for h in hits]], ["stem", "clean", "toxic"])

    def word_pairs(batches):
        for batch in batches:
            pairs = set()
            for text in batch.column(0).to_pylist():
                words = TOKEN.findall((text or "").lower())
                pairs.update(zip(words, ["", *words], strict=False))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.string()), pa.array([b for _, b in pairs], pa.string())], ["word", "before"])

    toxic = rows.where("toxic = 1")
    need = max(MIN_SUPPORT, math.ceil(SHARE * toxic.count()))
    counted = rows.mapInArrow(count_rows, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    counted = counted.where(F.col("toxic") >= need).where(F.col("toxic") >= F.lit(PRECISION) * (F.col("toxic") + F.col("clean")))
    stem = F.explode(F.concat(F.array(F.concat(F.lit("="), "word")), F.filter(F.array(*[F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in PREFIXES]), lambda s: s.isNotNull())))
    pairs = toxic.select("text").mapInArrow(word_pairs, "word string, before string").distinct().select(stem.alias("stem"), "word", "before")
    pairs = pairs.join(counted.select("stem"), "stem")
    support = pairs.select("stem", "before").distinct().groupBy("stem").agg(F.count("*").alias("support")).where(F.col("support") >= need)
    words = pairs.select("stem", "word").distinct().groupBy("stem").agg(F.count("*").alias("words"))
    good = {r["stem"]: (r["toxic"], r["words"]) for r in counted.join(support, "stem").join(words, "stem").select("stem", "toxic", "words").collect()}
    return choose_entries(good)


def choose_entries(good: dict[str, tuple[int, int]]) -> frozenset:
    """good: entry -> (toxic rows, different words). Beginnings of enough words, each as long as it
    can be without losing rows or words; then the whole words that none of them begins."""
    begins = {s for s, (_, words) in good.items() if not s.startswith("=") and words >= MIN_WORDS}
    longer = {}
    for s in begins:
        for k in PREFIXES:
            if k < len(s):
                longer.setdefault(s[:k], []).append(s)
    kept = {s for s in begins if not any(good[q][0] >= SAME * good[s][0] and good[q][1] >= SAME * good[s][1] for q in longer.get(s, ()))}
    covered = lambda word, own: any(word[:k] in kept for k in PREFIXES if k < own)
    out = {s for s in kept if not covered(s, len(s))}
    return frozenset(out | {s for s in good if s.startswith("=") and not covered(s[1:], len(s))})


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, steps: int = 200) -> list[float]:
    """Logistic regression around PRIOR within LOWEST and HIGHEST: Newton steps over the parameters
    that no bound holds, halved until the loss falls."""
    x = np.hstack([np.ones((len(x), 1)), x])

    def loss(w):
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + ridge / 2 * np.sum((w - PRIOR) ** 2))

    w = PRIOR.copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - PRIOR)
        free = np.flatnonzero(~((w <= LOWEST) & (gradient > 0)) & ~((w >= HIGHEST) & (gradient < 0)))
        if np.abs(gradient[free]).max(initial=0) < 1e-7:
            break
        hessian = (x[:, free] * (p * (1 - p))[:, None]).T @ x[:, free] + ridge * np.eye(len(free))
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(hessian, gradient[free])
        scale, now = 1.0, loss(w)
        while loss(new := np.clip(w - scale * step, LOWEST, HIGHEST)) > now and scale > 1e-9:
            scale /= 2
        w = new
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, limit: int = TRAIN_ROWS) -> Model:
    """A model from labelled rows outside fold 0, the same however the rows are partitioned. Without
    toxic rows it has no lexicon and knows threats only."""
    rows = materialize(training_rows(docs, labels, folds, limit))
    lexicon = fit_lexicon(rows)

    def features(batches):
        trigger, machine = trigger_pattern(lexicon), Grammar()
        for batch in batches:
            x = np.array([measure(t, lexicon, trigger, machine) for t in batch.column(0).to_pylist()]).reshape(-1, len(PARAMETERS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], ["x", "y"])

    data = sorted(tuple(r) for r in rows.mapInArrow(features, "x array<double>, y int").groupBy("x", "y").count().collect())  # no more than TRAIN_ROWS
    n = [r[2] for r in data]
    x = np.repeat(np.array([r[0] for r in data]).reshape(-1, len(PARAMETERS) - 1), n, axis=0)
    return Model(lexicon, fit_weights(x, np.repeat(np.array([r[1] for r in data], float), n)))


# ---------------------------------------------------------------- operators
def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs with a column score (double, 0 to 1) behind the others. A null or empty text has no
    clause and gets the score of its absence; a column score that docs has is replaced."""
    kept = [n for n in docs.columns if n.lower() != "score"]
    docs = docs.select(*[f"`{n}`" for n in kept])
    names = list(kept)

    def run(batches):
        for batch in batches:
            texts = batch.column(names.index("text")).cast(pa.string()).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.scores(texts), pa.float64())], [*names, "score"])

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{ddl}, score double")


def accept(docs: DataFrame, model: Model, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score below limit, all columns kept, whatever their names. A null or
    empty text has no clause and stays; repeated rows are judged one by one; an empty table gives an
    empty result."""
    at = next(k for k, n in enumerate(docs.columns) if n.lower() == "text")

    def run(batches):
        for batch in batches:
            scores = np.array(model.scores(batch.column(at).cast(pa.string()).to_pylist()))
            yield batch.filter(pa.array(scores < limit))

    return docs.mapInArrow(run, docs.schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents, learned from labels outside fold 0 of 5."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
