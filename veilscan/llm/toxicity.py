"""Toxicity by a weighted finite-state pattern grammar.

A clause's words run through a cascade of transducers (arc tables, composed into
one machine when the module is loaded):

* lexical: a word becomes a symbol with a weight: insult, threat, target,
  negation, report, or none of them. Insults come from a lexicon with weights
  (words and word stems, ``LEXICON_SIZE`` entries at most) that is learned from
  the labels; the function words are short lists of four languages.
* target, right to left: a person word marks the ``SCOPE`` words before it.
* negation: marks the ``SCOPE`` words after a negation.
* reported speech: marks everything in the clause after a verb of saying.
* target, left to right: marks the ``SCOPE`` words after a person word.
* judge: turns the marks of an insult or threat into its kind (plain, targeted,
  negated, reported, threat), on an arc with a weight.

A match weighs its word's weight times its arc's, and a clause the largest match
of each kind. So it is clauses that score, not words: a document's features are
the largest clause weight of each kind (up to ``HEAVIEST``) and the number of
matched clauses, and a logistic model over them, held near hand-set weights by
its prior, gives the score. Time is linear in the words, whatever their clauses.

Learning uses at most ``SAMPLE`` labelled rows (a documented bound); word counts
by label are aggregated in Spark and only words that pass the bounds on
support and weight reach the driver. Scoring maps over all rows without a shuffle.

Defined cases: null and empty texts have no clause and the lowest score; without
labels of both kinds only the threat grammar and the prior weights speak;
repeated rows score alike; conflicting labels of an id count as 1; a very long
text is one list of words in a task, read in two passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import workers
from .quality import labelled
from .transducers import compose, machine, run

SAMPLE = 20_000
THRESHOLD = 0.5
SCOPE = 4
#: A lexicon word occurs in this share of toxic sample rows at least, and so many times as often as in others.
SUPPORT, LEAST_SUPPORT, LEAST_WEIGHT = 0.01, 4, 2.5
STEMS = (4, 5, 6)
LEXICON_SIZE = 4096
HEAVIEST = 6.0
KINDS = ("plain", "targeted", "negated", "reported", "threat")
PRIOR = np.array([-3.0, 1.5, 2.0, 0.3, 0.5, 2.0, 0.5])
PRIOR_SPREAD = np.array([3.0, 1.5, 1.5, 1.5, 1.5, 1.0, 1.0])
EDGES = b".,!?;:\"'()[]{}<>*_-\xc2\xa1\xc2\xbf"
ENDS = frozenset(b".!?;:")

NEGATION = "not no never none isn't aren't wasn't don't nicht kein keine keinen nie pas jamais aucun ne nunca ningún ninguna tampoco"
REPORT = "said says say told claims claimed wrote quoted reported called sagte sagt behauptet schrieb dit disait affirme écrit dijo dice afirma escribió"
TARGET = "you your yours u he she they them him her people du dich dir dein euch ihr sie tu toi te vous ton votre il elle tú ti usted ustedes él ella ellos"
THREAT = "kill hurt destroy murder shoot stab beat töten umbringen schlagen vernichten tuer frapper détruire matar golpear destruir"


class Grammar(NamedTuple):
    words: dict[bytes, float]  # insult weights of whole words
    stems: dict[bytes, float]  # and of word beginnings
    weights: np.ndarray  # logistic weights: constant, one for each kind, clauses


def _word_set(text: str) -> frozenset[bytes]:
    return frozenset(text.encode().split())


NEGATIONS, REPORTS, TARGETS, THREATS = map(_word_set, (NEGATION, REPORT, TARGET, THREAT))


def insult_weight(word: bytes, words: dict[bytes, float], stems: dict[bytes, float]) -> float:
    found = words.get(word, 0.0)
    if stems:
        for n in STEMS:
            if len(word) > n:
                found = max(found, stems.get(word[:n], 0.0))
    return found


INSULT, DANGER, PERSON, NO, SAYS, NEGATED, REPORTED, NEAR = (1 << k for k in range(8))


def _scope(opens: int, marks: int, own: bool):
    """A machine that marks the SCOPE words after an opening one (and that one, if ``own``)."""
    return machine(SCOPE + 1, lambda s, x: (SCOPE if x & opens else max(0, s - 1), x | (marks if s or own and x & opens else 0)))


def _judge(state: int, x: int) -> tuple[int, int]:
    """Number of the match's kind, from 1; 0 where there is none."""
    if not x & (INSULT | DANGER):
        return 0, 0
    if x & (REPORTED | NEGATED):
        kind = "reported" if x & REPORTED else "negated"
    elif x & INSULT:
        kind = "targeted" if x & NEAR else "plain"
    else:
        kind = "threat" if x & NEAR else ""
    return 0, KINDS.index(kind) + 1 if kind else 0


TARGETED = _scope(PERSON, NEAR, True)
GRAMMAR = compose(compose(compose(_scope(NO, NEGATED, False), machine(2, lambda s, x: (s or int(x & SAYS > 0), x | (REPORTED if s else 0)))), TARGETED), machine(1, _judge))
#: Weight of the judge's arcs, by kind.
ARC_WEIGHT = {"plain": 1.0, "targeted": 1.0, "negated": 1.0, "reported": 1.0, "threat": 2.0}


def symbol(word: bytes, words: dict[bytes, float], stems: dict[bytes, float]) -> tuple[int, float]:
    """The lexical machine: a word's symbol and weight."""
    weight, danger = insult_weight(word, words, stems), word in THREATS
    made = INSULT * (weight > 0) | DANGER * danger | PERSON * (word in TARGETS) | NO * (word in NEGATIONS) | SAYS * (word in REPORTS)
    return made, weight or 1.0


def run_clause(clause: list[bytes], words: dict[bytes, float], stems: dict[bytes, float]) -> dict[str, float]:
    """Largest weight of each kind that the composed machine gives the clause."""
    made = [symbol(word, words, stems) for word in clause]
    marked = run(TARGETED, [x for x, _ in reversed(made)])[::-1]
    out: dict[str, float] = {}
    for number, (_, weight) in zip(run(GRAMMAR, marked), made, strict=True):
        if number:
            kind = KINDS[number - 1]
            out[kind] = max(out.get(kind, 0.0), weight * ARC_WEIGHT[kind])
    return out


def features(text: str | None, words: dict[bytes, float], stems: dict[bytes, float]) -> list[float]:
    """Of each kind the largest clause weight (scaled to about 1), and the logarithm of matched clauses."""
    raw = (text or "").encode().lower().split()
    bare = [w.strip(EDGES) for w in raw]
    hits = [k for k, w in enumerate(bare) if w in words or w in THREATS or (stems and (w[:5] in stems or w[:4] in stems or w[:6] in stems))]
    best = dict.fromkeys(KINDS, 0.0)
    clauses, done = 0, -1
    for k in hits:
        if k <= done:
            continue
        start, end = k, k
        while start > done + 1 and raw[start - 1][-1] not in ENDS:
            start -= 1
        while end + 1 < len(raw) and raw[end][-1] not in ENDS:
            end += 1
        done = end
        made = run_clause(bare[start : end + 1], words, stems)
        clauses += bool(made)
        for kind, weight in made.items():
            best[kind] = max(best[kind], weight)
    return [*(min(best[kind], HEAVIEST) / 3 for kind in KINDS), math.log1p(clauses)]


def logistic(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-(weights[0] + x @ weights[1:])))


def fit_weights(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Most probable logistic weights under a normal prior around PRIOR, by Newton steps; row k counts n[k] times."""
    weights = PRIOR.copy()
    if not len(y):
        return weights
    wide = np.concatenate((np.ones((len(x), 1)), x), axis=1)
    for _ in range(50):
        p = logistic(x, weights)
        slope = wide.T @ (n * (p - y)) + (weights - PRIOR) / PRIOR_SPREAD**2
        bend = (wide * (n * p * (1 - p))[:, None]).T @ wide + np.diag(1 / PRIOR_SPREAD**2)
        step = np.linalg.solve(bend, slope)
        weights = weights - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return weights


def units(text: str) -> set[bytes]:
    """Whole words, and word beginnings marked by a trailing star."""
    bare = {w.strip(EDGES) for w in text.encode().lower().split()}
    bare.discard(b"")
    return bare | {w[:n] + b"*" for w in bare for n in STEMS if len(w) > n}


def learn_lexicon(rows: DataFrame) -> tuple[dict[bytes, float], dict[bytes, float]]:
    """Words and stems of (text, label) rows that speak for label 1; each distinct text counts once."""

    def count(batches: Iterator[pa.RecordBatch]):
        seen: dict[bytes, list[int]] = {}

        def send():
            keys = list(seen)
            made = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *[pa.array([seen[k][c] for k in keys], pa.int64()) for c in (0, 1)]], names=["unit", "clean", "toxic"])
            seen.clear()
            return made

        for batch in batches:
            for text, label in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                for unit in units(text.as_py()):
                    seen.setdefault(unit, [0, 0])[label] += 1
                if len(seen) > 500_000:
                    yield send()
        yield send()

    rows = rows.groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("label").alias("label")).select("text", "label")
    clean, toxic = (int(x or 0) for x in rows.agg(F.sum(F.lit(1) - F.col("label")), F.sum("label")).first())
    if not clean or not toxic:
        return {}, {}
    counts = workers(rows).mapInArrow(count, "unit binary, clean long, toxic long").groupBy("unit").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    strong = counts.withColumn("weight", weight).where((F.col("toxic") >= max(LEAST_SUPPORT, SUPPORT * toxic)) & (F.col("weight") >= LEAST_WEIGHT))
    words, stems = {}, {}
    for r in strong.orderBy(F.desc("weight"), "unit").limit(LEXICON_SIZE).collect():
        unit = bytes(r["unit"])
        if unit.endswith(b"*"):
            stems[unit[:-1]] = r["weight"]
        else:
            words[unit] = r["weight"]
    return words, stems


def train(documents: DataFrame, labels: DataFrame, learn: Column, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Grammar:
    """Learn lexicon and clause weights from the rows for which ``learn`` (over the labels table) holds."""
    chosen = labelled(labels, learn, label_col, sample, id_col)
    rows = documents.join(F.broadcast(chosen), documents[id_col] == chosen["__id"]).where(F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col("__label").alias("label"))
    words, stems = learn_lexicon(rows)

    def measure(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            made = [features(t.as_py(), words, stems) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(made, pa.list_(pa.float64()))], names=["label", "x"])

    made = workers(rows).mapInArrow(measure, "label int, x array<double>").groupBy("label", "x").count().collect()
    x = np.array([r["x"] for r in made]).reshape(-1, len(KINDS) + 1)
    y, n = (np.array([r[c] for r in made], dtype=np.float64) for c in ("label", "count"))
    return Grammar(words, stems, fit_weights(x, y, n))


def score(documents: DataFrame, grammar: Grammar, text_col: str = "text", out: str = "score") -> DataFrame:
    """The rows with their score between 0 and 1 in column ``out``."""

    def judge(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x = np.array([features(t.as_py(), grammar.words, grammar.stems) for t in batch.column(batch.num_columns - 1)]).reshape(-1, len(KINDS) + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(logistic(x, grammar.weights), pa.float64())], schema=pa.schema([*list(batch.schema)[:-1], pa.field(out, pa.float64())]))

    kept = documents.drop(out)
    schema = kept.schema.add(out, "double")
    return workers(kept).withColumn("__text", F.col(text_col).cast("string")).mapInArrow(judge, schema)
