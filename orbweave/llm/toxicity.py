"""Toxicity by a weighted finite-state pattern grammar.

A lexicon reads a clause word by word into symbols: insults and threats (with the weight of their arc), targets, negations
and words of reported speech. Four small transducers read the symbols and mark the hits: the hit itself, whether a
negation reaches it, whether it is reported, whether the clause is aimed at somebody. Their composition is computed
once, as a product over reachable states; a path's weight is the sum of its arcs' weights, and a clause has exactly one
accepting path (the target transducer guesses at its start and rejects where the guess was wrong). A hit's marks give its
class, and a text is scored by its classes: a logistic model weighs them, with fixed weights as the prior mean, so that a
class without evidence keeps its own, and with negated and reported hits held below targeted ones.

The insult arcs are learned: words and stems (beginnings of words) that labelled toxic texts have far more often than
other texts, over all labelled rows that may be learned from. The logistic model is fitted on hits of arcs that were
chosen without the text (two folds). The words of the other transducers are fixed lists.

Most clauses hold no insult or threat, and an Aho-Corasick automaton finds those that do. Nulls count as empty texts,
which get the score of a text without hits. Very long texts are read whole. Without any labels of both kinds every text
scores 0. Rows may repeat; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import short_batches, stage

# Words of the transducers that are not learned, in English, German, French and Spanish.
THREATS = "kill hurt destroy beat shoot stab burn attack umbringen töten schlagen verletzen tuer frapper détruire matar golpear destruir".split()
TARGETS = "you your yourself u he she they them him her his their these those du dich dir ihr euch dein er sie diese tu te toi vous votre ton il elle ils elles ces tú usted ustedes él ella ellos ellas esos".split()
NEGATIONS = "not no never isn't aren't don't doesn't wasn't nicht kein keine nie niemals ne pas jamais non nunca jamás ni".split()
REPORTS = "said says say told wrote claimed quoted reported called according sagte sagt schrieb laut dit disait selon écrit dijo dice según escribió".split()
#: Documents learned from at most, of each label, chosen by a hash of their id.
LABELLED = 10_000
#: Arcs that the insult transducer may have, the least documents for one, and how many times likelier it makes the label.
ARCS, SUPPORT, LIFT = 3000, 4, 8.0
STEMS = range(4, 9)
#: How many words a negation or report reaches.
REACH = 4

_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
_CLAUSE = re.compile(r"[.!?;\n]")
CLASSES = ("insult", "targeted", "negated", "reported", "threat", "threat_targeted")
FEATURES = len(CLASSES) + 4
#: Prior means of the logistic weights, by class and then the four other features; the most that a negated or reported
#: hit weighs, as a part of a targeted one.
PRIOR = (1.5, 2.5, 0.3, 0.2, 0.5, 2.5, 0.0, 0.0, 0.0, 0.0)
HELD_BELOW = {"negated": 0.8, "reported": 0.6}

#: Symbols that the lexicon writes and the transducers read.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
HITS = (INSULT, THREAT)


@dataclass
class Transducer:
    """Reads symbols and writes a set of marks for each; arcs: (state, symbol) -> (next state, marks)."""

    starts: tuple
    finals: frozenset
    arcs: dict[tuple, tuple]

    def paths(self, symbols: list[int]) -> list[list[frozenset]]:
        """The marks along every accepting path."""
        live = [(s, []) for s in self.starts]
        for x in symbols:
            live = [(self.arcs[s, x][0], [*out, self.arcs[s, x][1]]) for s, out in live if (s, x) in self.arcs]
        return [out for s, out in live if s in self.finals]


def transducers(reach: int = REACH) -> tuple[Transducer, ...]:
    """Hits, negation, reported speech, target."""
    none, symbols = frozenset(), range(6)
    hit = Transducer((0,), frozenset({0}), {(0, x): (0, frozenset({"insult"} if x == INSULT else {"threat"} if x == THREAT else ())) for x in symbols})
    mark = lambda name, x: frozenset({name}) if x in HITS else none
    negation = {(s, x): (reach if x == NEGATION else max(0, s - 1), mark("negated", x) if s else none) for s in range(reach + 1) for x in symbols}
    report = {(s, x): (int(s or x == REPORT), mark("reported", x) if s else none) for s in (0, 1) for x in symbols}
    aimed = {(s, x): ("seen" if x == TARGET else s, mark("targeted", x)) for s in ("due", "seen") for x in symbols}
    aimed |= {("none", x): ("none", none) for x in symbols if x != TARGET}
    return (
        hit,
        Transducer((0,), frozenset(range(reach + 1)), negation),
        Transducer((0,), frozenset({0, 1}), report),
        Transducer(("due", "none"), frozenset({"seen", "none"}), aimed),
    )


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The machine that does what both do: ``b`` reads what ``a`` passes on and adds its marks. Reachable states only."""
    starts = tuple((s, t) for s in a.starts for t in b.starts)
    arcs, todo, seen = {}, list(starts), set(starts)
    while todo:
        s, t = todo.pop()
        for x in range(6):
            if (s, x) in a.arcs and (t, x) in b.arcs:
                (n, one), (m, two) = a.arcs[s, x], b.arcs[t, x]
                arcs[(s, t), x] = (n, m), one | two
                if (n, m) not in seen:
                    seen.add((n, m))
                    todo.append((n, m))
    return Transducer(starts, frozenset(q for q in seen if q[0] in a.finals and q[1] in b.finals), arcs)


def class_of(marks: frozenset) -> int:
    """The class of a hit, as its place in CLASSES, by its marks; -1 where there is no hit."""
    if not marks & {"insult", "threat"}:
        return -1
    for name in ("reported", "negated"):
        if name in marks:
            return CLASSES.index(name)
    if "threat" in marks:
        return CLASSES.index("threat_targeted" if "targeted" in marks else "threat")
    return CLASSES.index("targeted" if "targeted" in marks else "insult")


def compiled() -> tuple[list[int], list[bool], list[list[int]], list[list[int]]]:
    """The composition of all transducers as tables: starts, finals, next state (-1: none) and class by state and symbol."""
    machine = reduce(compose, transducers())
    number = {q: i for i, q in enumerate(sorted({*machine.starts, *(q for q, _ in machine.arcs), *(n for n, _ in machine.arcs.values())}, key=repr))}
    follow, classes = [[-1] * 6 for _ in number], [[-1] * 6 for _ in number]
    for (q, x), (n, marks) in machine.arcs.items():
        follow[number[q]][x], classes[number[q]][x] = number[n], class_of(marks)
    return [number[q] for q in machine.starts], [q in machine.finals for q in number], follow, classes


@dataclass
class Grammar:
    """The transducers, and the weights of their outputs."""

    arcs: dict[str, float]  # words, or stems with a trailing star
    weights: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.finder = ahocorasick.Automaton()
        for x in self.arcs:
            self.finder.add_word(x.rstrip("*"), True)
        for x in THREATS:
            self.finder.add_word(x, True)
        self.finder.make_automaton()
        self.stems = sorted({len(x) - 1 for x in self.arcs if x.endswith("*")}, reverse=True)
        self.fixed = {w: x for x, words in ((TARGET, TARGETS), (THREAT, THREATS), (REPORT, REPORTS), (NEGATION, NEGATIONS)) for w in words}
        self.starts, self.finals, self.follow, self.classes = compiled()

    def insult(self, word: str) -> float:
        """The weight of the arc that reads the word: its own, or that of its longest stem."""
        found = self.arcs.get(word)
        if found is None:
            found = next((self.arcs[s] for n in self.stems if len(word) >= n and (s := word[:n] + "*") in self.arcs), 0.0)
        return found

    def read(self, words: list[str]) -> list[tuple[int, float]]:
        """What the lexicon writes: (symbol, weight) of every word."""
        out = []
        for w in words:
            x = self.fixed.get(w)
            if x is None:
                weight = self.insult(w)
                out.append((INSULT, weight) if weight else (OTHER, 0.0))
            else:
                out.append((x, 1.0 if x == THREAT else 0.0))
        return out

    def clause(self, words: list[str]) -> list[tuple[str, float]]:
        """Run the composed machine over a clause: (class, weight) of every hit on its accepting path."""
        tape = self.read(words)
        for state in self.starts:
            out = []
            for x, weight in tape:
                hit, state = self.classes[state][x], self.follow[state][x]
                if state < 0:
                    break
                if hit >= 0:
                    out.append((CLASSES[hit], weight))
            if state >= 0 and self.finals[state]:
                return out
        return []

    def features(self, text: str) -> np.ndarray:
        """Of a whole text: hits by class, the largest and mean weight, distinct clauses and hits for its length."""
        out = np.zeros(FEATURES)
        low = text.lower()
        n, clauses, weights, seen = 0, 0, [], -1
        for at, _ in self.finder.iter(low):
            if at <= seen:
                continue  # in a clause that was read already
            starts = max(low.rfind(c, 0, at) for c in ".!?;\n") + 1
            end = _CLAUSE.search(low, at)
            seen = end.start() if end else len(low)
            hits = self.clause(_WORD.findall(low, starts, seen))
            clauses += bool(hits)
            for kind, weight in hits:
                n += 1
                weights.append(weight)
                out[CLASSES.index(kind)] += 1
        out[: len(CLASSES)] = np.log1p(out[: len(CLASSES)])
        k = len(CLASSES)
        if n:
            out[k], out[k + 1] = max(weights), sum(weights) / n
            out[k + 2], out[k + 3] = math.log1p(clauses), math.log1p(1000 * n / (1 + len(low)))
        return out

    def score(self, text: str) -> float:
        if self.weights is None:
            return 0.0
        x = float(self.weights[0] + self.weights[1:] @ self.features(text))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def fit_logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, prior: np.ndarray | None = None, ridge: float = 0.1, steps: int = 40) -> np.ndarray:
    """Weights, the constant first, by Newton's method with a small ridge around the prior; each row counts so many times."""
    x = np.hstack([np.ones((len(x), 1)), x])
    mean = np.concatenate([[0.0], np.zeros(x.shape[1] - 1) if prior is None else prior])
    w, fine = mean.copy(), np.eye(x.shape[1]) * ridge
    fine[0, 0] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (times * (p * (1 - p) + 1e-9))[:, None]).T @ x + fine, x.T @ (times * (y - p)) - fine @ (w - mean))
        w += step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(id_col: str = "doc_id"):
    """Whether a row is kept from learning: by the CRC-32 of its id as text."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 5 == 0, F.lit(True))


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words and stems of each text, with its label and fold."""
    for batch in batches:
        terms, labels, folds = [], [], []
        for text, label, fold in zip(*(c.to_pylist() for c in batch.columns)):
            words = set(_WORD.findall(text.lower()))
            words = {w for w in words if 2 < len(w) < 40}
            found = words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}
            terms += found
            labels += [label] * len(found)
            folds += [fold] * len(found)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(labels, pa.int32()), pa.array(folds, pa.int32())], names=["term", "label", "fold"])


def _choose(counts: DataFrame, sizes: dict[tuple[int, int], int], folds: tuple[int, ...]) -> dict[str, float]:
    """Arcs from the rows of some folds: at most ARCS terms, by lift and support."""
    yes, no = (sum(sizes.get((k, f), 0) for f in folds) for k in (1, 0))
    if not yes or not no:
        return {}
    toxic, other = (sum(F.col(f"{name}{f}") for f in folds) for name in ("toxic", "other"))
    lift = ((toxic + 0.1) / yes) / ((other + 0.5) / no)
    best = counts.select("term", toxic.alias("toxic"), lift.alias("lift")).where((F.col("toxic") >= min(SUPPORT, max(2, SUPPORT * len(folds) // 2))) & (F.col("lift") >= LIFT))
    best = best.orderBy(F.desc(F.log("lift") * F.sqrt("toxic")), "term").limit(ARCS).collect()
    arcs = {r["term"]: math.log(r["lift"]) for r in best}
    for term in [t for t in arcs if not t.endswith("*")]:  # a word that a stem reads as well needs no arc
        if any(term[:n] + "*" in arcs and arcs[term[:n] + "*"] >= arcs[term] for n in STEMS):
            del arcs[term]
    return arcs


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED) -> Grammar:
    """The grammar from labelled rows that are not held out, at most ``labelled`` of each label (a fixed bound).

    Labels are drawn at different rates where the bound holds, so rows count for all of their label when scores are fitted.
    """
    spark = docs.sparkSession
    short_batches(spark)
    may = labels.where(~held_out(id_col)).where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    times = {r["label"]: max(1.0, r["count"] / labelled) for r in may.groupBy("label").count().collect()}
    order = F.xxhash64("_id")
    chosen = [may.where(F.col("label") == k).orderBy(order, "_id").limit(labelled) for k in (0, 1)]
    chosen = stage(chosen[0].unionByName(chosen[1]).dropDuplicates(["_id"]), "labelled")
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")
    texts = stage(texts.select("text", "label", F.pmod(F.xxhash64(F.lit(1), "_id"), F.lit(2)).cast("int").alias("fold")), "labelled_texts")
    sizes = {(r["label"], r["fold"]): r["count"] for r in texts.groupBy("label", "fold").count().collect()}
    if {k for k, _ in sizes} != {0, 1}:
        return Grammar({})
    counts = texts.mapInArrow(_terms, "term string, label int, fold int").groupBy("term").agg(
        *[F.sum(F.when((F.col("label") == k) & (F.col("fold") == f), 1).otherwise(0)).alias(f"{name}{f}") for name, k in (("toxic", 1), ("other", 0)) for f in (0, 1)]
    )
    counts = stage(counts, "terms")
    arcs = _choose(counts, sizes, (0, 1))
    apart = {f: _choose(counts, sizes, (1 - f,)) or arcs for f in (0, 1)}  # for the texts of a fold, from those of the other
    grammar = Grammar(arcs)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {f: Grammar(x) for f, x in apart.items()}
        for batch in batches:
            found = [own[f].features(t).tolist() for t, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.float64()))], names=["label", "x"])

    rows = texts.mapInArrow(describe, "label int, x array<double>").collect()  # at most 2 * labelled rows
    x, y = np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float)
    order = np.lexsort([*x.T, y])
    w = fit_logistic(x[order], y[order], np.array([times[k] for k in y[order].astype(int)]), np.array(PRIOR))
    for name, part in HELD_BELOW.items():
        at = 1 + CLASSES.index(name)
        w[at] = min(w[at], part * max(0.0, w[1 + CLASSES.index("targeted")]))
    grammar.weights = w
    return grammar


def score_documents(docs: DataFrame, grammar: Grammar, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row, in one pass without a shuffle."""
    short_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    arcs, weights = grammar.arcs, grammar.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(arcs, weights)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.score(t or "") for t in batch.column(1).to_pylist()], pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {id_type}, score double").withColumnRenamed("id", id_col)


def drop_toxic(docs: DataFrame, grammar: Grammar, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, all columns."""
    short_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    arcs, weights = grammar.arcs, grammar.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Grammar(arcs, weights)
        for batch in batches:
            yield batch.filter(pa.array([own.score(t or "") < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
