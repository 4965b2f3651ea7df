"""Toxicity by a weighted finite-state pattern grammar over clauses.

Transducers map the words of a clause to weighted marks (insult, threat, target, negation, reported speech); their
composition reads the marks in one pass, with the states *plain*, *negated* (for a few words after a negation) and
*reported* (after a verb of saying or inside quotation marks), and emits the weight of each match under its state.
A document's score is a logistic function of what its matched clauses weigh.

The insult transducer is learned: whole words and stems whose odds in toxic training documents are high.
Null and empty texts have no clause and get the score of the intercept. Fitting reads at most ``sample`` labelled
documents (chosen by a hash of the id); a corpus without both labels gets the seed words and fixed weights.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import fresh_name, give_back, materialize, release

# The words of the hand-written transducers.
INSULT = "idiot idiots moron morons loser losers scum stupid clown pathetic worthless trash disgusting dumb jerk".split()
THREAT = "kill hurt destroy beat punish crush attack shoot stab burn".split()
TARGET = "you your yours he she they him her them his their people".split()
NEGATION = "not no never none isn't aren't wasn't don't doesn't didn't won't can't nicht kein keine ne pas jamais nunca".split()
REPORT = "said says say called calls wrote writes claimed claims quoted quotes reported reports allegedly sagte dit dijo".split()

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[\"“”«»]|[.!?;\n]+")
SAMPLE = 12_000
STEMS = (4, 5, 6)
NEGATED, REPORTED, DIRECTED = 0.4, 0.5, 1.25
THRESHOLD = 0.7


def terms(words: list[str]) -> set[str]:
    """What the insult transducer can be learned on: whole words and stems (marked by a final hyphen)."""
    return {*words, *(w[:k] + "-" for w in words for k in STEMS if len(w) > k)}


class Transducer:
    """A weighted finite-state transducer over word classes. Arcs: (state, class) -> (next state, weight); a class without an arc stays, at weight 1.

    ``ends``: what a state gives a clause that stops there, as (factor, bonus).
    """

    def __init__(self, start, arcs: dict, ends: dict | None = None):
        self.start, self.arcs, self.ends = start, arcs, ends or {}

    def step(self, state, kind: str):
        return self.arcs.get((state, kind), (state, 1.0))

    def end(self, state) -> tuple[float, float]:
        return self.ends.get(state, (1.0, 0.0))

    def compose(self, other: Transducer) -> Transducer:
        """Both in one: it runs in pairs of states that can be reached, weights multiply, factors multiply and bonuses add."""
        start = (self.start, other.start)
        arcs, ends, todo, seen = {}, {}, [start], {start}
        while todo:
            pair = todo.pop()
            (f, x), (g, y) = self.end(pair[0]), other.end(pair[1])
            ends[pair] = (f * g, x + y)
            for kind in CLASSES:
                (p, v), (q, w) = self.step(pair[0], kind), other.step(pair[1], kind)
                arcs[pair, kind] = ((p, q), v * w)
                if (p, q) not in seen:
                    seen.add((p, q))
                    todo.append((p, q))
        return Transducer(start, arcs, ends)


#: Word classes: insult, threat, target, negation, report, quotation mark, end of a clause, any other.
CLASSES = "IHTNRQE-"


def negation() -> Transducer:
    """Counts down three words from a negation; an insult met meanwhile weighs less."""
    arcs = {(n, k): (max(0, n - 1), NEGATED if k == "I" and n else 1.0) for n in range(4) for k in "IHTR-"}
    return Transducer(0, arcs | {(n, "N"): (3, 1.0) for n in range(4)} | {(n, "E"): (0, 1.0) for n in range(4)})


def speech() -> Transducer:
    """Reported (until the clause ends) or quoted (until the next mark): either makes an insult weigh less."""
    arcs = {}
    for reported in (False, True):
        for quoted in (False, True):
            s = (reported, quoted)
            arcs |= {(s, "R"): ((True, quoted), 1.0), (s, "Q"): ((reported, not quoted), 1.0), (s, "E"): ((False, quoted), 1.0), (s, "I"): (s, REPORTED if reported or quoted else 1.0)}
    return Transducer((False, False), arcs)


def directed() -> Transducer:
    """A target makes a clause's insults weigh more; a threat that is not negated and a target add one."""
    arcs, ends = {}, {}
    for target in (False, True):
        for threat in (False, True):
            for left in range(4):
                s = (target, threat, left)
                down = max(0, left - 1)
                arcs |= {(s, k): ((target, threat, down), 1.0) for k in "IR-"}
                arcs |= {(s, "T"): ((True, threat, down), 1.0), (s, "H"): ((target, threat or not left, down), 1.0), (s, "N"): ((target, threat, 3), 1.0), (s, "E"): ((False, False, 0), 1.0)}
                ends[s] = (DIRECTED if target else 1.0, 1.0 if target and threat else 0.0)
    return Transducer((False, False, 0), arcs, ends)


class Grammar:
    """Negation, reported speech, target and threat composed into one transducer, behind the insult lexicon that puts words into classes.

    ``insults``: weight by word or stem. States are numbered; a step is a look-up in ``table``.
    """

    def __init__(self, insults: dict[str, float]):
        self.insults = {**dict.fromkeys(INSULT, 2.0), **insults}
        self.marks = {**{w: "T" for w in TARGET}, **{w: "N" for w in NEGATION}, **{w: "R" for w in REPORT}}
        self.threats = frozenset(THREAT)
        self.memory: dict[str, tuple[float, str]] = {}
        whole = negation().compose(speech()).compose(directed())
        number = {s: i for i, s in enumerate([whole.start, *(s for s in whole.ends if s != whole.start)])}
        self.table = [{k: (number[whole.arcs[s, k][0]], whole.arcs[s, k][1]) for k in CLASSES} for s in number]
        self.ends = [whole.ends[s] for s in number]

    def read(self, w: str) -> tuple[float, str]:
        """The insult weight of a word and its mark."""
        got = self.memory.get(w)
        if got is None:
            weight = max([self.insults.get(w, 0.0), *(self.insults.get(w[:k] + "-", 0.0) for k in STEMS if len(w) > k)])
            got = (weight, "I" if weight > 0 else "H" if w in self.threats else self.marks.get(w, "-"))
            if len(self.memory) > 100_000:
                self.memory.clear()
            self.memory[w] = got
        return got

    def clauses(self, text: str) -> Iterator[float]:
        """The weight of each matched clause."""
        table, state, total = self.table, 0, 0.0
        for w in [*WORD.findall(text.lower()), "."]:
            if w[0] in ".!?;\n":
                factor, bonus = self.ends[state]
                if total or bonus:
                    yield total * factor + bonus
                state, total = table[state]["E"][0], 0.0
            elif w in '"“”«»':
                state = table[state]["Q"][0]
            else:
                weight, kind = self.read(w)
                state, share = table[state][kind]
                total += weight * share

    def features(self, text: str | None) -> list[float]:
        found = list(self.clauses(text or ""))
        total = sum(found)
        n = 1 + len(text or "") / 1000
        return [1.0, math.log1p(total), max(found, default=0.0), math.log1p(len(found)), total / n]


def learned(df: DataFrame, least: int = 3) -> dict[str, float]:
    """Insult weights from rows (text, toxic): terms in ``least`` toxic documents or more whose smoothed log-odds exceed 2.

    All such terms come to the driver: the sample of labelled documents bounds them, not the corpus.
    """
    total = df.agg(F.sum("toxic"), F.count("*")).first()
    pos, neg = int(total[0] or 0), int(total[1] - (total[0] or 0))
    if not pos or not neg:
        return {}
    words = F.expr(r"array_distinct(filter(split(lower(coalesce(text, '')), '[^\\p{L}]+', -1), w -> w <> ''))")
    stems = F.expr("array_distinct(concat(w," + ",".join(f"transform(filter(w, x -> length(x) > {k}), x -> concat(left(x, {k}), '-'))" for k in STEMS) + "))")
    counted = df.select("toxic", words.alias("w")).select("toxic", F.explode(stems).alias("term")).groupBy("term").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n"))
    odds = F.log((F.col("p") + 0.5) / (pos + 1.0)) - F.log((F.col("n") + 0.5) / (neg + 1.0))
    best = counted.where(F.col("p") >= least).withColumn("odds", odds).where("odds > 2 and p > 4 * n")
    return {r.term: min(4.0, r.odds / 2) for r in best.collect()}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[dict[str, float], list[float]]:
    """Insult weights and the weights of the logistic function, from labelled documents outside the held-out third.

    At most ``sample`` labelled ids are used, which bounds what is broadcast, written and collected. Null labels are
    ignored; of repeated ids the higher label counts.
    """
    ids = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    ids = ids.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = materialize(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic"), "tox")
    # The weights are learned on one half and the logistic function on the other, lest it trust the terms too much;
    # then all rows teach the terms.
    half = F.xxhash64(F.coalesce("text", F.lit(""))) % 2
    grammar = Grammar(learned(rows.where(half == 0)))

    @pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([grammar.features(t) for t in s])

    got = rows.where(half != 0).select("toxic", features("text").alias("f")).collect()
    y = np.array([r.toxic for r in got], float)
    if not len(y) or y.min() == y.max():
        return {}, [-4.0, 3.0, 0.0, 0.0, 0.0]
    weights = logistic(np.array([r.f for r in got]), y)
    return learned(rows), weights.tolist()


def score(docs: DataFrame, model: tuple[dict[str, float], list[float]], name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` from 0 to 1, from the text alone. A column of that name must not be there yet."""
    insults, weights = model
    if name.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"there is a column {name} already")

    @pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        grammar, w = Grammar(insults), np.array(weights)
        for s in batches:
            x = np.array([grammar.features(t) for t in s]).reshape(-1, len(w))
            yield pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))
        del grammar
        give_back()

    return docs.withColumn(name, scored("text"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents scored below the threshold; columns stay, whatever their names. Repeated rows stay too, null texts count as empty."""
    name = fresh_name(docs, "score")
    return score(docs, train(docs.select("doc_id", "text"), labels), name).where(F.col(name) < threshold).select(*docs.columns)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's columns over all of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return scored.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
