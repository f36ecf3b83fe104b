"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read the words of a clause and are composed into one machine:
insult and threat map words to weights, target (whom it is said to) raises the
weight of what stands in the same clause, negation lowers what follows it for a
few words, and reported speech lowers what follows to the clause's end. A
clause's score is the weight of its best path: the sum of its weighted arcs in
their context. Isolated words count only through the clauses they stand in.

The word lists of target, negation, report and threat are fixed. The arcs of the
insult transducer are learned: a prefix tree of words and word beginnings, each
with its log-odds among toxic and other labelled texts. A logistic regression
over four clause scores of a text gives the probability. Both are fitted on at
most ``MAX_LABELLED`` labelled rows (smallest hash of the id first), and the
tree has at most ``MAX_ARCS`` arcs; scoring reads every whole text.

Defined cases: null and empty texts have no clauses and still a score; rows of
labels without id or label are left out, an id that is labelled twice is toxic
if any row says so; without labels of both kinds, fixed arcs and coefficients
score; repeated rows get equal scores; long texts are read clause by clause;
extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import keyed_text, scratch_table

# Words of the transducers that are not learned.
TARGETS = frozenset("you your he she they them his her their du sie ihr er tu vous il elle ils tú usted él ella ellos".split())
NEGATIONS = frozenset("not no never nicht kein keine nie ne pas jamais nunca jamás".split())
REPORTS = frozenset("said says wrote claimed called quoted sagte schrieb nannte dit écrit dijo escribió llamó".split())
THREATS = {w: 3.0 for w in "kill hurt destroy burn töten tuer frapper matar golpear".split()}
DEFAULT_INSULTS = {"=" + w: 5.0 for w in "idiot stupid moron scum trash loser pathetic worthless disgusting clown".split()}

MAX_LABELLED = 20_000
MAX_ARCS = 50_000
MIN_TEXTS = 3          # toxic texts an arc must occur in
MIN_WEIGHT = 2.0       # log-odds of an arc
PREFIX = range(3, 9)
TARGET_FACTOR, NEGATION_FACTOR, REPORT_FACTOR = 1.1, 0.8, 0.9
NEGATION_REACH = 3
MAX_WORDS = 200_000    # words whose weight a worker remembers

_CLAUSE = re.compile(r"[.;!?\n]+")
_WORD = re.compile(r"\w+")
FEATURES = ("best", "total", "density", "length")


def arcs_of(word: str) -> list[str]:
    return ["=" + word] + [word[:k] for k in PREFIX if k < len(word)]


@dataclass
class Grammar:
    """The composed machine. Its state in a clause is (words for which negation
    still holds, reported or not); targets weigh the whole clause."""

    insults: dict[str, float]
    _known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"insults": self.insults, "_known": {}}

    def weight(self, word: str) -> float:
        got = self._known.get(word)
        if got is None:
            if len(self._known) >= MAX_WORDS:
                self._known.clear()
            got = max(max(self.insults.get(a, 0.0) for a in arcs_of(word)), THREATS.get(word, 0.0))
            self._known[word] = got
        return got

    def clause(self, words: list[str]) -> float:
        weights = [*map(self.weight, words)]
        if not any(weights):
            return 0.0
        total, negated, reported, target = 0.0, 0, False, False
        for word, w in zip(words, weights):
            if w:
                total += w * (NEGATION_FACTOR if negated else 1.0) * (REPORT_FACTOR if reported else 1.0)
            negated = NEGATION_REACH if word in NEGATIONS else max(0, negated - 1)
            reported = reported or word in REPORTS
            target = target or word in TARGETS
        return total * (TARGET_FACTOR if target else 1.0)

    def features(self, text: str | None) -> tuple[float, float, float, float]:
        best = total = 0.0
        n = 0
        for part in _CLAUSE.split((text or "").lower()):
            words = _WORD.findall(part)
            n += len(words)
            score = self.clause(words)
            total += score
            best = max(best, score)
        return best, math.log1p(total), total / max(n, 1), math.log1p(n)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of the bounded sample that models learn from."""
    y = labels.select("doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out()) \
        .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    y = y.orderBy(F.crc32(F.col("doc_id").cast("string").cast("binary")), "doc_id").limit(MAX_LABELLED)
    return texts.join(y, "doc_id").select("text", "toxic")


def learn_arcs(sample: DataFrame) -> dict[str, float]:
    """Weights of the arcs that mark toxic texts."""
    def run(batches):
        for batch in batches:
            arcs, toxic = [], []
            for text, y in zip(batch.column("text"), batch.column("toxic")):
                found = {a for w in set(_WORD.findall((text.as_py() or "").lower())) for a in arcs_of(w)}
                arcs += found
                toxic += [y.as_py()] * len(found)
            yield pa.RecordBatch.from_pydict({"arc": pa.array(arcs, pa.string()), "toxic": pa.array(toxic, pa.int32())})

    size = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if len(size) < 2:
        return dict(DEFAULT_INSULTS)
    counts = sample.mapInArrow(run, "arc string, toxic int").groupBy("arc").agg(
        F.sum("toxic").alias("yes"), F.count("*").alias("n"))
    odds = F.log((F.col("yes") + 0.5) / (size[1] + 1)) - F.log((F.col("n") - F.col("yes") + 0.5) / (size[0] + 1))
    best = counts.filter(F.col("yes") >= MIN_TEXTS).withColumn("w", odds).filter(F.col("w") > MIN_WEIGHT) \
        .orderBy(F.desc("yes"), "arc").limit(MAX_ARCS)
    return {r["arc"]: r["w"] for r in best.select("arc", "w").collect()}


def featured(rows: DataFrame, grammar: Grammar) -> DataFrame:
    """``rows`` with the clause scores in place of ``text``."""
    others = [c for c in rows.columns if c != "text"]
    machine = rows.sparkSession.sparkContext.broadcast(grammar)

    def run(batches):
        for batch in batches:
            x = [machine.value.features(t.as_py()) for t in batch.column("text")]
            columns = np.array(x, np.float64).reshape(len(x), len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in others] + [pa.array(columns[:, k]) for k in range(len(FEATURES))],
                                             names=[*others, *FEATURES])

    kinds = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in others] + [f"{c} double" for c in FEATURES]
    return rows.mapInArrow(run, ", ".join(kinds))


@dataclass(frozen=True)
class Logistic:
    mean: tuple = (0.0,) * len(FEATURES)
    scale: tuple = (1.0,) * len(FEATURES)
    weights: tuple = (0.5, 0.0, 0.0, 0.0)
    bias: float = -2.0

    def column(self) -> Column:
        z = F.lit(float(self.bias))
        for name, m, s, w in zip(FEATURES, self.mean, self.scale, self.weights):
            z = z + (F.col(name) - float(m)) / float(s) * float(w)
        return 1.0 / (1.0 + F.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> Logistic:
    """Newton's method on at most ``MAX_LABELLED`` rows of four numbers."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
    return Logistic(tuple(mean.tolist()), tuple(scale.tolist()), tuple(w[:-1].tolist()), float(w[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Grammar, Logistic]:
    sample = scratch_table(labelled(keyed_text(docs, id_col, text_col), labels), "labelled")
    grammar = Grammar(learn_arcs(sample))
    rows = featured(sample, grammar).collect()
    y = np.array([r["toxic"] for r in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return grammar, Logistic()
    return grammar, fit(np.array([[r[c] for c in FEATURES] for r in rows], np.float64), y)


def score(docs: DataFrame, model: tuple[Grammar, Logistic], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, clause scores, score) of every text."""
    grammar, logistic = model
    return featured(keyed_text(docs, id_col, text_col), grammar).withColumn("score", logistic.column())


def digest(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
