"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps the words of a clause to classes: slurs with weights, intensifiers, harm, intent, targets,
negations, reporting words, quotes. Five transducers are composed with it. Insult: a slur is an insult, a strong one after an intensifier
or another slur. Threat: a harm word is a threat if intent goes before it or a target follows soon, else mere harm. Target: insults after a target
are aimed. Negation: what follows soon after a negation is negated. Reported speech: what stands after a reporting word or
in quotes is reported. The composition is one automaton; it runs over the clauses that have a slur or harm word and puts out hits, whose arcs tell
which parameters their path carries. A path's weight is the product of its parameters (``PARAMETERS``), which are fitted, not
set: a document's score is a logistic function of the sum over all hits of slur weight times path weight, alone and by length.

Slurs are words and word beginnings. Their weights are learned: of at most ``TRAIN_DOCS`` labelled documents (by hash order), Spark counts
toxic and clean documents for each word and word beginning; those of high log-odds enter the lexicon beside a base list. All that pass
enter it: each stands in a share of ``LEAST_SHARE`` of the toxic documents, so there are at most 200 times as many as a document has. A
part of the same sample, left out of the counts, fits the parameters and the logistic function. Rows with crc32(doc_id) mod 5 = 0
are never learned from.

Edge cases: a null or empty text has no clauses and gets the score of no match; a null id counts as held
out; several labels of an id or of equal texts count as the highest, null labels are ignored; labels without any toxic
row leave the base list and a score below one half without a match; repeated rows stay repeated; only the named columns
are read, so extra columns cannot clash; an empty table gives an empty table; texts are read whole.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import stored, strings, with_arrow_columns

TRAIN_DOCS = 20_000
#: A learned entry stands in this many, and this share, of the toxic documents; and has this log-odds at least.
LEAST_DOCS, LEAST_SHARE, LEAST_ODDS = 3, 0.005, 2.5
#: Lengths of word beginnings that can be stems.
STEM = range(3, 9)
FOLDS = 5

# The base word lists.
INSULTS = "idiot idiots moron morons scum loser losers trash clown clowns worthless stupid pathetic disgusting dumb fool idiota imbécile crétin dummkopf trottel estúpido".split()
HARMS = "kill hurt beat destroy burn shoot stab hang strangle töten umbringen tuer frapper matar golpear".split()
INTENTS = "will gonna going shall must werde werden vais allons voy vamos".split()
INTENSIFIERS = "so such total totally complete completely utter utterly absolute fucking damn sehr total très tellement muy tan".split()
TARGETS = "you your yours u he she they them him her these those this that people du dich ihr euch sie tu te vous toi ils elles tú usted ustedes ellos".split()
NEGATIONS = "not no never none nobody neither nor without nicht kein keine nie niemals ne pas jamais aucun sin nunca jamás ningún".split()
REPORTS = "said says say saying told tells called calls calling wrote writes claimed claims quoted reported sagte sagt nannte dit disait appelé dijo dice llamó".split()
#: A base word's weight where the sample has none of it, and at least: clean uses in context don't make it harmless.
BASE_WEIGHT, LEAST_BASE = 3.0, 1.0

#: Classes that the lexical transducer puts out, and hits that the others make of them.
SLUR, INTENSIFIER, HARM, INTENT, TARGET, NEGATION, REPORT, QUOTE, OTHER, END = "slur", "intensifier", "harm", "intent", "target", "negation", "report", "quote", "other", "end"
CLASSES = (SLUR, INTENSIFIER, HARM, INTENT, TARGET, NEGATION, REPORT, QUOTE, OTHER, END)
INSULT, THREAT, MERE = "insult", "threat", "mere harm"
HITS = (INSULT, THREAT, MERE)
#: Parameters that arcs carry, and the logarithms from which fitting starts and to which it is drawn.
PARAMETERS = {"strong": math.log(1.2), "threat": math.log(3.0), "mere": math.log(0.3), "aimed": math.log(1.5), "negated": math.log(0.3), "reported": math.log(0.5)}
#: Words over which an intensifier, an intent, a harm word or a negation reaches.
REACH = 3

CLAUSE = re.compile(r"[.!?;:\n]+")
WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”„«»]")


@dataclass
class Transducer:
    """Arcs (state, symbol) -> (next state, symbol put out, parameters); a missing arc copies the symbol and stays."""

    start: object
    arcs: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol), (state, symbol, ()))


def compose(first: Transducer, second: Transducer) -> Transducer:
    """What ``second`` makes of ``first``'s output, as one transducer over pairs of states; parameters add up."""
    out = Transducer((first.start, second.start))
    todo, seen = [out.start], {out.start}
    while todo:
        a, b = todo.pop()
        for symbol in CLASSES:
            a2, middle, own = first.step(a, symbol)
            b2, last, more = second.step(b, middle)
            out.arcs[(a, b), symbol] = ((a2, b2), last, own + more)
            if (a2, b2) not in seen:
                seen.add((a2, b2))
                todo.append((a2, b2))
    return out


def counting_down(opener: str, steps: tuple[str, ...]) -> dict:
    """Arcs of states REACH to 0: the opener goes to REACH, every word of the steps to one less."""
    arcs = {(s, opener): (REACH, opener, ()) for s in range(REACH + 1)}
    return arcs | {(s, k): (s - 1, k, ()) for s in range(1, REACH + 1) for k in steps}


def insult_transducer() -> Transducer:
    """Slurs are insults, strong ones soon after an intensifier or another slur."""
    arcs = counting_down(INTENSIFIER, (TARGET, REPORT, QUOTE, OTHER, NEGATION, INTENT, HARM))
    arcs |= {(s, SLUR): (REACH, INSULT, ("strong",) if s else ()) for s in range(REACH + 1)}
    return Transducer(0, arcs)


def threat_transducer() -> Transducer:
    """Harm words are threats soon after an intent, or if a target follows soon; else, once that is known, mere harm."""
    arcs = counting_down(INTENT, (OTHER, TARGET))
    for s in range(REACH + 1):
        arcs[s, HARM] = (0, THREAT, ("threat",)) if s else (-REACH, OTHER, ())
    for s in range(-REACH, 0):  # a harm word waits for a target
        arcs[s, TARGET] = (0, THREAT, ("threat",))
        arcs[s, OTHER] = (s + 1, OTHER, ()) if s < -1 else (0, MERE, ("mere",))
        arcs[s, HARM] = (-REACH, MERE, ("mere",))
        arcs[s, END] = (0, MERE, ("mere",))
    return Transducer(0, arcs)


def target_transducer() -> Transducer:
    """Insults after a target or a threat are aimed."""
    return Transducer(0, {(0, TARGET): (1, TARGET, ()), (0, THREAT): (1, THREAT, ()), (1, INSULT): (1, INSULT, ("aimed",))})


def negation_transducer() -> Transducer:
    """Hits soon after a negation are negated."""
    arcs = counting_down(NEGATION, (TARGET, REPORT, QUOTE, OTHER, INTENT, INTENSIFIER))
    return Transducer(0, arcs | {(s, k): (s - 1, k, ("negated",)) for s in range(1, REACH + 1) for k in HITS})


def report_transducer() -> Transducer:
    """Hits after a reporting word, and within quotes, are reported."""
    arcs = {(0, REPORT): ("said", REPORT, ())}
    arcs |= {(s, QUOTE): ("quoted", QUOTE, ()) for s in (0, "said")} | {("quoted", QUOTE): (0, QUOTE, ())}
    return Transducer(0, arcs | {(s, k): (s, k, ("reported",)) for s in ("said", "quoted") for k in HITS})


def cascade() -> list[Transducer]:
    return [insult_transducer(), threat_transducer(), target_transducer(), negation_transducer(), report_transducer()]


def grammar() -> Transducer:
    first, *rest = cascade()
    for t in rest:
        first = compose(first, t)
    return first


AUTOMATON = grammar()
#: All sets of parameters that a hit's path can carry.
PATHS = sorted({tuple(sorted(own)) for _, put, own in AUTOMATON.arcs.values() if put in HITS})


class Grammar:
    """The lexicon and the composed automaton, ready to read texts."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.words, self.stems, self.harms = words, stems, set(HARMS)
        lists = ((INTENT, INTENTS), (INTENSIFIER, INTENSIFIERS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (HARM, HARMS))
        self.other = {w: k for k, ws in lists for w in ws}
        self.begins = {s[:3] for s in (*stems, *words, *HARMS)}
        self.lengths = sorted({len(s) for s in stems}, reverse=True)
        place = {p: i for i, p in enumerate(PATHS)}
        self.arcs = {k: (to, put == INSULT, place[tuple(sorted(own))] if put in HITS else -1) for k, (to, put, own) in AUTOMATON.arcs.items()}

    def weight(self, word: str) -> float:
        """A word's weight as a slur; 0 if it is none."""
        found = self.words.get(word, 0.0)
        for n in self.lengths:
            if len(word) > n:
                found = max(found, self.stems.get(word[:n], 0.0))
        return found

    def classes(self, token: str) -> list[tuple[str, float]]:
        """The lexical transducer: what a token becomes."""
        if not token[0].isalpha():
            return [(QUOTE, 0.0)]
        if token.endswith(("n't", "n’t")):
            return [(NEGATION, 0.0)]
        out = []
        for word in WORD.findall(token):
            w = self.weight(word)
            out.append((SLUR, w) if w > 0 else (self.other.get(word, OTHER), 0.0))
        return out

    def clause(self, clause: str, sums: list[float]) -> bool:
        """Adds the weights of the clause's hits to the sums of their paths; whether it has any."""
        state, found = AUTOMATON.start, False
        symbols = [x for token in TOKEN.findall(clause) for x in self.classes(token)]
        for symbol, w in (*symbols, (END, 0.0)):
            state, is_insult, path = self.arcs[state, symbol]
            if path >= 0:
                sums[path] += w if is_insult else 1.0
                found = True
        return found

    def text(self, text: str) -> tuple[list[float], int, int]:
        """The sums of hits by path, the number of clauses with a hit, the number of words."""
        low, sums = text.lower(), [0.0] * len(PATHS)
        words = WORD.findall(low)
        begins, harms = self.begins, self.harms
        hits = {w for w in set(words) if w[:3] in begins and (w in harms or self.weight(w) > 0)}
        n = 0
        if hits:
            n = sum(self.clause(c, sums) for c in CLAUSE.split(low) if not hits.isdisjoint(WORD.findall(c)))
        return sums, n, len(words)


#: Which parameters each path carries.
CARRIES = np.array([[name in path for name in PARAMETERS] for path in PATHS], float)


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    #: Logarithms of the parameters, then constant and factors of the logistic function.
    fitted: list[float]

    @property
    def path_weights(self) -> list[float]:
        return np.exp(CARRIES @ np.array(self.fitted[: len(PARAMETERS)])).tolist()


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def held_out(doc_id: Column) -> Column:
    return fold(doc_id) == 0


def training_sample(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> DataFrame:
    """text, toxic, fit (whether for the parameters) of at most ``most`` labelled rows that aren't held out; equal texts once."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = known.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)  # at most 16 bytes a row
    chosen = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(some), "doc_id")
    return chosen.select("text", "toxic", (fold(F.col("doc_id")) == FOLDS - 1).alias("fit")).groupBy("text", "fit").agg(F.max("toxic").alias("toxic"))


def counts(sample: DataFrame) -> DataFrame:
    """feature (a word with $ after it, or the beginning of a longer word), n_toxic, n_clean: texts that have it."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    long = F.filter(words, lambda w: F.length(w) >= STEM[0])
    parts = F.flatten(F.transform(long, lambda w: F.array(F.concat(w, F.lit("$")), *(F.when(F.length(w) > n, F.substring(w, 1, n)) for n in STEM))))
    once = sample.select("toxic", F.explode(F.array_distinct(parts)).alias("feature")).where("feature is not null")
    return once.groupBy("feature").agg(F.sum("toxic").alias("n_toxic"), F.sum(1 - F.col("toxic")).alias("n_clean"))


def lexicon(found: list[tuple[str, int, int]], toxic: int, clean: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with weights (log-odds), from counts of documents.

    A beginning stands for all words that share it; of nested beginnings in nearly the same documents the longest is
    taken, and a whole word instead of a beginning that hardly another word shares.
    """
    odds = lambda t, c: math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * toxic))
    seen = {f: (t, odds(t, c)) for f, t, c in found}
    good = {f: x for f, x in seen.items() if x[0] >= least and x[1] >= LEAST_ODDS}
    shorter = lambda f: f[:-2][: STEM[-1]] if f.endswith("$") else f[:-1]
    inner = defaultdict(list)  # by beginning: what is one letter longer, and the whole words that end or go on there
    for f in good:
        inner[shorter(f)].append(f)
    words = {w: (max(LEAST_BASE, seen[f"{w}$"][1]) if f"{w}$" in seen else BASE_WEIGHT) for w in INSULTS}
    stems: dict[str, float] = {}
    ranked = sorted((f for f in good if shorter(f) not in good), key=lambda f: (-good[f][0], f))
    for f in ranked:
        while not f.endswith("$") and (deeper := max(inner[f], key=lambda g: good[g][0], default=None)) and good[deeper][0] >= 0.9 * good[f][0]:
            f = deeper
        if f.endswith("$"):
            words[f[:-1]] = max(words.get(f[:-1], 0.0), good[f][1])
        else:
            stems[f] = good[f][1]
    return words, stems


def fit(sums: np.ndarray, n_words: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> list[float]:
    """Parameters (logarithms) and the logistic function's constant and two factors, by Fisher scoring.

    A ridge draws the parameters to where they start, and the logistic function weakly to a rule of thumb.
    """
    own = len(PARAMETERS)
    prior = np.array([*PARAMETERS.values(), -2.0, 1.0, 0.0])
    pull = np.array([ridge] * own + [0.05] * 3)
    rate = 1000 / (n_words + 20)

    def look(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        by_path = sums * np.exp(CARRIES @ v[:own])
        total = by_path.sum(axis=1)
        x = np.column_stack([np.ones(len(total)), np.log1p(total), np.log1p(rate * total)])
        z = np.clip(x @ v[own:], -30, 30)
        slope = v[own + 1] / (1 + total) + v[own + 2] * rate / (1 + rate * total)
        loss = float(np.logaddexp(0, z).sum() - (y * z).sum() + (pull * (v - prior) ** 2).sum() / 2)
        return np.column_stack([(by_path @ CARRIES) * slope[:, None], x]), 1 / (1 + np.exp(-z)), loss

    v = prior.copy()
    jacobian, p, loss = look(v)
    for _ in range(100):
        gradient = jacobian.T @ (p - y) + pull * (v - prior)
        hessian = (jacobian * (p * (1 - p))[:, None]).T @ jacobian + np.diag(pull)
        step = np.linalg.solve(hessian, gradient)
        while True:
            jacobian, p, found = look(v - step)
            if found <= loss or np.abs(step).max() < 1e-9:
                break
            step = step / 2
        v, loss = v - step, found
        if np.abs(step).max() < 1e-8:
            break
    return [float(x) for x in v]


def with_matches(docs: DataFrame, words: dict[str, float], stems: dict[str, float]) -> DataFrame:
    """Adds sums (of hits by path), n_clauses and n_words of each text."""

    def make():
        own = Grammar(words, stems)

        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            a, b, c = zip(*map(own.text, strings(batch.column("text"))))
            return [pa.array(a, pa.list_(pa.float64())), pa.array(b, pa.int64()), pa.array(c, pa.int64())]

        return work

    return with_arrow_columns(docs, {"sums": T.ArrayType(T.DoubleType()), "n_clauses": T.LongType(), "n_words": T.LongType()}, make)


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """The lexicon, the parameters and the logistic function from at most ``most`` labelled documents."""
    sample = stored(training_sample(docs, labels, most), "sample")
    rows = sample.where(~F.col("fit"))
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    least = max(LEAST_DOCS, math.ceil(LEAST_SHARE * toxic))
    # A beginning with this share of toxic documents can have the least odds; the rest need not be collected.
    ratio = math.exp(LEAST_ODDS) * (toxic + 1) / (clean + 1)
    strong = (F.col("n_toxic") >= least) & (F.col("n_toxic") + 0.5 >= (F.col("n_clean") + 0.5) * ratio)
    base = F.col("feature").isin([f"{w}$" for w in INSULTS])
    found = counts(rows).where(strong | base).collect()
    words, stems = lexicon(sorted(map(tuple, found)), toxic, clean)
    fitted = with_matches(sample.where("fit").select("toxic", "text"), words, stems).select("toxic", "sums", "n_words").collect()
    fitted.sort(key=lambda r: (r["n_words"], r["toxic"], r["sums"]))  # so that sums of floats don't depend on partitions
    sums = np.array([r["sums"] for r in fitted]).reshape(len(fitted), len(PATHS))
    return Model(words, stems, fit(sums, np.array([float(r["n_words"]) for r in fitted]), np.array([float(r["toxic"] > 0) for r in fitted])))


def logit(model: Model) -> Column:
    """The logistic function's argument, from sums and n_words."""
    total = sum((F.element_at("sums", i + 1) * w for i, w in enumerate(model.path_weights)), F.lit(0.0))
    a, b, c = model.fitted[len(PARAMETERS) :]
    return a + b * F.log1p(total) + c * F.log1p(1000 * total / (F.col("n_words") + 20))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted, n_clauses (clauses that have a hit)."""
    matched = with_matches(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), model.words, model.stems)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), logit(model)))))
    return matched.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), "n_clauses")


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score is below one half."""
    renamed = docs.withColumnsRenamed({c: f"own_{c}" for c in docs.columns}).withColumn("text", F.coalesce("own_text", F.lit("")))
    matched = with_matches(renamed, model.words, model.stems)
    return matched.where(logit(model) < 0).select(*(F.col(f"own_{c}").alias(c) for c in docs.columns))
