"""Toxicity scores from a weighted finite-state pattern grammar over clauses.

Each word of a clause has a class: insult or threat (with a weight), target,
negation, reporting word, or other. Four small weighted transducers read the
classes: negation damps the few words after it, a reporting word damps the rest
of its clause, an address to a target strengthens an insult and is what makes a
threat count (one before it, or one that waits a few words for it), and the insult transducer passes the weights. They are composed
into one machine whose arcs carry the product of the weights; it runs once over
every clause that holds an insult or a threat. The clauses' weights, not single
words, make up a document's features, and a logistic curve maps these to 0..1.

Two thirds of all labelled documents give the insult weights (log odds of a
word's document frequencies): every word is counted and tested in Spark, at the
labels' own shares, so the tests do not depend on the size of the input; the
driver gets the words that pass. The curve is learned from the other third of at
most ``PER_CLASS`` documents of each label (smallest id hash, whole texts),
classes weighed back to their shares among all labelled rows; the driver gets
their feature rows, 2 * PER_CLASS at most.

Defined cases: null, empty or wordless texts get the score of a text without any
matched clause; without labels of both kinds the weights are the built-in ones;
several labels of one document count as toxic if any does; repeated rows and
null ids are scored like any row; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import cut, first_rows

#: Labelled documents per label value to learn the curve from.
PER_CLASS = 6_000
#: A learned word needs this many toxic documents, log odds and deviation in standard errors.
LEAST_DOCS, LEAST_ODDS, LEAST_Z = 4, 2.0, 5.0
#: Words of the model at most; beyond that the most significant ones are its lexicon.
LEXICON = 50_000

#: Weight of a threat that meets its target.
THREAT = 2.0
TARGETS = frozenset("you your yours u ya yall du dich dir dein deine ihr euch tu toi te vos votre vous tú ti usted ustedes vosotros".split())
NEGATIONS = frozenset("not no never neither nor isnt arent dont cannot nicht kein keine nie ne pas jamais aucun nunca ni tampoco".split())
REPORTS = frozenset("said says say called calls wrote writes quote quoted reported claimed sagte sagt nannte schrieb dit dits appelé écrit dijo dice llamó escribió".split())
THREATS = dict.fromkeys("kill hurt destroy murder stab shoot strangle umbringen töten verletzen tuer frapper matar herir".split(), THREAT)

_CLAUSE = re.compile(r"[.!?;:|\n]+")
_WORD = re.compile(r"[^\W_]+")


@dataclass
class Transducer:
    """Arcs (state, symbol) -> (state, symbol, weight) and a final weight per state.

    A symbol without an arc passes unchanged at weight 1, by ``rest`` (state -> state).
    """

    arcs: dict[tuple, tuple]
    rest: dict = field(default_factory=dict)
    final: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (self.rest.get(state, state), symbol, 1.0)


def negation(span: int = 3, damp: float = 0.25) -> Transducer:
    """The ``span`` words after a negation are in its scope."""
    arcs = {(s, "neg"): (span, "other", 1.0) for s in range(span + 1)}
    arcs |= {(s, k): (s - 1, k, damp) for s in range(1, span + 1) for k in ("insult", "paid")}
    return Transducer(arcs, {s: s - 1 for s in range(1, span + 1)})


def reported(damp: float = 0.5) -> Transducer:
    """All after a reporting word is someone else's."""
    return Transducer({(0, "report"): (1, "other", 1.0), (1, "report"): (1, "other", 1.0),
                       (1, "insult"): (1, "insult", damp), (1, "paid"): (1, "paid", damp)})


def target(boost: float = 1.5) -> Transducer:
    """States: 0 nothing, 1 insult, 2 target, 3 both; an address raises the clause, whichever comes first."""
    arcs = {(0, "target"): (2, "other", 1.0), (1, "target"): (3, "other", 1.0),
            (0, "insult"): (1, "insult", 1.0), (2, "insult"): (3, "insult", 1.0)}
    arcs |= {(s, "paid"): (3, "paid", 1.0) for s in range(4)}
    return Transducer(arcs, final={3: boost})


def threat(span: int = 3) -> Transducer:
    """A threat counts after a target ("you ... kill"), or with a target up to ``span`` words
    after it ("kill all of you"): it waits, and the target pays for it; else it weighs nothing.

    States: 0 nothing, 1 target, 2 and up a waiting threat and the words it may still pass.
    """
    waits = range(2, 2 + span)
    arcs = {(0, "target"): (1, "target", 1.0), (1, "threat"): (1, "insult", 1.0)}
    arcs |= {(s, "threat"): (1 + span, "other", 1.0) for s in (0, *waits)}
    arcs |= {(s, "target"): (1, "paid", 1.0) for s in waits}
    return Transducer(arcs, {s: s - 1 if s > 2 else 0 for s in waits})


def compose(a: Transducer, b: Transducer, symbols: list[str]) -> Transducer:
    """The machine that feeds ``a``'s output to ``b``; weights multiply. States are pairs."""
    arcs, todo, seen = {}, [(0, 0)], {(0, 0)}
    while todo:
        s, t = todo.pop()
        for k in symbols:
            s2, out, w = a.step(s, k)
            t2, out2, v = b.step(t, out)
            arcs[(s, t), k] = ((s2, t2), out2, w * v)
            if (s2, t2) not in seen:
                seen.add((s2, t2))
                todo.append((s2, t2))
    return Transducer(arcs, final={p: a.final.get(p[0], 1.0) * b.final.get(p[1], 1.0) for p in seen})


SYMBOLS = ["insult", "threat", "target", "neg", "report", "other"]


def grammar() -> Transducer:
    """Threats, negation, report and target composed, states numbered from 0."""
    machine = threat()
    for part in (negation(), reported(), target()):
        machine = compose(machine, part, SYMBOLS)
        number = {(0, 0): 0}
        for s, _ in machine.arcs:
            number.setdefault(s, len(number))
        machine = Transducer({(number[s], k): (number[n], out, w) for (s, k), (n, out, w) in machine.arcs.items()},
                             final={number[s]: w for s, w in machine.final.items()})
    return machine


class Scorer:
    """Lexicon, composed grammar and logistic curve."""

    def __init__(self, insults: dict[str, float]):
        self.weight = THREATS | insults
        self.insults = frozenset(insults)
        self.machine = grammar()
        self.curve = np.array([-3.0, 1.0, 0.5, 0.1])

    def _symbol(self, word: str) -> str:
        if word in self.insults:
            return "insult"
        return ("threat" if word in THREATS else "target" if word in TARGETS else "neg" if word in NEGATIONS
                else "report" if word in REPORTS else "other")

    def clause(self, words: list[str]) -> float:
        state, total = 0, 0.0
        for w in words:
            state, out, factor = self.machine.step(state, self._symbol(w))
            if out == "insult":
                total += factor * self.weight[w]
            elif out == "paid":
                total += factor * THREAT
        return total * self.machine.final.get(state, 1.0)

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Strongest clause, log of the clauses' sum, and log of the sum per hundred words."""
        low = (text or "").lower()
        if self.weight.keys().isdisjoint(_WORD.findall(low)):
            return 0.0, 0.0, 0.0
        clauses, n = [], 0
        for part in _CLAUSE.split(low):
            words = _WORD.findall(part)
            n += len(words)
            if not self.weight.keys().isdisjoint(words):
                clauses.append(self.clause(words))
        total = sum(clauses)
        return max(clauses), float(np.log1p(total)), float(np.log1p(100 * total / n))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Ridge logistic regression by Newton steps."""
        x, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            g = x.T @ (weight * (p - y)) + 0.1 * beta
            h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(4)
            beta -= (step := np.linalg.solve(h, g))
            if np.abs(step).max() < 1e-8:
                break
        self.curve = beta

    def score(self, text: str | None) -> float:
        z = self.curve[0] + float(np.dot(self.curve[1:], self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _mapped(df: DataFrame, keep: list[str], fields: str, types: list, make) -> DataFrame:
    """Rows of ``keep`` and what ``make`` yields for the text."""
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = [], []
            for i, text in enumerate(b.column(len(keep)).to_pylist()):
                found = list(make(text))
                rows += found
                at += [i] * len(found)
            cols = [pa.array([r[j] for r in rows], t) for j, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([c.take(pa.array(at, pa.int64())) for c in b.columns[:-1]] + cols, [*keep, *names])

    given = df.select(*keep, F.col("text").alias("_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in given.schema.fields[:-1])
    return given.mapInArrow(run, schema + fields)


def _counted(rows: DataFrame) -> DataFrame:
    """word, n1, n: toxic and all documents of ``rows`` (toxic, text) that hold the word, from ``LEAST_DOCS`` toxic ones on; "" is in each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, toxic = Counter(), Counter()
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = {*_WORD.findall((text or "").lower()), ""}
                found.update(words)
                if y:
                    toxic.update(words)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array([toxic[w] for w in found], pa.int64()), pa.array(list(found.values()), pa.int64())], ["word", "n1", "n"])

    each = rows.select("toxic", "text").mapInArrow(run, "word string, n1 long, n long")
    return each.groupBy("word").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n")).where((F.col("n1") >= LEAST_DOCS) | (F.col("word") == ""))


def learn(docs: DataFrame, labels: DataFrame) -> Scorer:
    """A scorer from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic); rows may be left out beforehand."""
    spark = docs.sparkSession
    marked = (labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id")
              .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))
    marked = marked.join(docs.select("doc_id").where("doc_id IS NOT NULL").distinct(), "doc_id", "left_semi")
    picked = first_rows(marked, ["toxic"], [F.xxhash64("doc_id"), F.col("doc_id")], PER_CLASS).drop("_n")
    totals = {r.toxic: r.n for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if set(totals) != {0, 1}:
        return Scorer({})
    fit = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    texts = docs.select("doc_id", "text")
    # labels grow with the input: one join at every size
    counts = cut(_counted(texts.where(~fit).join(marked.where(~fit).hint("merge"), "doc_id")))
    # the empty word stands in every document: its counts are the documents'
    every = counts.where("word = ''").first()
    insults = {}
    if every:
        n1, n = every.n1, every.n
        expected, odds = F.col("n") * (n1 / n), F.log((F.col("n1") + 0.5) / (n1 + 1) / ((F.col("n") - F.col("n1") + 0.5) / (n - n1 + 1)))
        passed = counts.where(F.col("word") != "").withColumn("odds", odds).withColumn("z", (F.col("n1") - expected) / F.sqrt(expected)).where(
            (F.col("odds") >= LEAST_ODDS) & (F.col("z") >= LEAST_Z))
        best = passed.orderBy(F.desc("z"), "word").limit(LEXICON)
        insults = {r.word: min(r.odds, 6.0) for r in best.select("word", "odds").collect()}
    scorer = Scorer(insults)
    shared = spark.sparkContext.broadcast(scorer)  # the words that passed
    sample = texts.where(fit).join(F.broadcast(picked.where(fit)), "doc_id")  # ids, 2 * PER_CLASS at most
    feats = _mapped(sample, ["toxic"], "a double, b double, c double", [pa.float64()] * 3,
                    lambda t: [shared.value.features(t)]).collect()  # 2 * PER_CLASS rows at most
    y = np.array([r.toxic for r in feats], float)
    if 0 < y.sum() < len(y):
        have = {0: (y == 0).sum(), 1: (y == 1).sum()}
        weight = np.array([totals[int(v)] / have[int(v)] for v in y])
        scorer.fit(np.array([[r.a, r.b, r.c] for r in feats]), y, weight * len(y) / weight.sum())
    return scorer


def score(docs: DataFrame, scorer: Scorer, keep: list[str]) -> DataFrame:
    """``keep`` columns and the score of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    return _mapped(docs, keep, "score double", [pa.float64()], lambda t: [(shared.value.score(t),)])
