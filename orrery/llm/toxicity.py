"""Toxicity by a weighted finite-state pattern grammar (operator 1).

A clause is read word by word. The lexicon transducer turns a word into a symbol: an insult of a level of one to eight, a threat
verb, a word of intent, a target, a negation, a word of reported speech, or any other; a word of the lexicon may also pass as any
other. Four transducers over symbols follow: threat (a verb of harm after a word of intent, or with a target), target (before or
after the insult), negation (the words after it) and reported speech (the rest of the clause). They are composed into one, whose
states are the reachable combinations. Weights add up along a path, and a clause's score is that of its best path. A document
is judged by the scores of its matched clauses and its length, never by single words outside them.

The lexicon's insults, whole words and word beginnings, and the final logistic weights are learned from labelled rows; the other
word classes are closed and given.

`max_labelled` bounds the rows that are learned from (the first by a hash of doc_id); two thirds of them give the lexicon, the
rest the logistic weights. Rows whose crc32(doc_id) is divisible by 5 are never learned from. labels, lang, source and doc_id
are no inputs of a score.

Defined results
    * null, empty and white texts get the score of a text without any match; repeated rows get equal scores
    * a doc_id labelled more than once counts as toxic if any of its labels does; a null label or doc_id is no label; a null
      doc_id is scored, and is not held out
    * without a label of either kind, or without any insult learned, every score is 0
    * further columns are ignored by `score` and kept by `reject`
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, trim, whole_text
from .tokens import texts_by_slice

#: Closed word classes in English, German, French and Spanish.
CLASSES = {
    "y": "you your yours yourself u ur he him his she her they them their du dich dir dein deine ihr euch euer sie ihn ihm toi tu te vous votre vos lui leur tú ti usted ustedes vosotros tus ellos",
    "n": "not no never nobody none neither nor hardly isn aren wasn weren don doesn didn won wouldn cannot without nicht kein keine keinen niemals nie weder pas jamais aucun aucune sans ni nunca ningún ninguno ninguna tampoco jamás sin",
    "r": "said says say saying wrote writes claimed claims quoted quotes called calls alleged reported sagte sagt schrieb nannte nennt behauptet zitiert disait dit écrit appelle prétend cite dijo dice escribió llamó afirma cita",
    "w": "will gonna going shall must should want wanna let ll werde werden will wollen soll muss vais va veux dois allons voy va vas quiero debo vamos",
    "v": "kill hurt destroy shoot stab strangle beat burn crush hang slaughter murder töten umbringen verletzen erschießen verprügeln tuer frapper massacrer égorger brûler matar golpear destruir quemar degollar",
}
WORD, CLAUSE = re.compile(r"[^\W\d_]+"), re.compile(r"[.!?;\n]+")
SHORTEST, LONGEST, LEVELS = 4, 9, 8
BEFORE, AFTER, NEGATED, INTENT = 6, 3, 4, 3
#: What a target adds to an emitted weight, and what negation and reported speech take, as shares; the weight of a threat.
TARGETED, DENIED, QUOTED, THREAT = 0.5, 0.6, 0.4, 4

Arcs = dict[object, dict[str, list[tuple[str, float, object]]]]


def compose(one: Arcs, two: Arcs) -> Arcs:
    """The transducer that feeds each output of one to two: its reachable states from (0, 0). Both read one symbol a step."""
    out: Arcs = {}
    todo = [(0, 0)]
    while todo:
        state = todo.pop()
        if state in out:
            continue
        a, b = one[state[0]], two[state[1]]
        out[state] = arcs = {}
        for symbol, steps in a.items():
            arcs[symbol] = [(o2, w1 + w2, (n1, n2)) for o1, w1, n1 in steps for o2, w2, n2 in b.get(o1, ())]
            todo += [n for _, _, n in arcs[symbol]]
    names = {s: k for k, s in enumerate(out)}  # (0, 0) is state 0
    return {names[s]: {x: [(o, w, names[n]) for o, w, n in steps] for x, steps in arcs.items()} for s, arcs in out.items()}


INSULTS = [f"i{k}" for k in range(1, LEVELS + 1)]
SIGNS = [*INSULTS, "t", "y", "n", "r", "o"]
END = "$"  # read after a clause's last word


def _weight(symbol: str) -> float:
    """What an insult or threat emits before the other transducers: its level."""
    return float(symbol[1:]) if symbol in INSULTS else float(THREAT) if symbol == "t" else 0.0


def threats() -> Arcs:
    """v becomes t within INTENT words after w; else it is v still, which only a target makes a threat."""
    out: Arcs = {}
    for left in range(INTENT + 1):
        arcs = {x: [(x, 0.0, max(0, left - 1))] for x in (*INSULTS, "y", "n", "r", "o")}
        arcs["w"] = [("o", 0.0, INTENT)]
        arcs["v"] = [("t", float(THREAT), left - 1)] if left else [("v", 0.0, 0)]
        arcs[END] = [(END, 0.0, 0)]
        out[left] = arcs
    return out


def targets() -> Arcs:
    """Insults and threats gain a share of their weight where a target is at most BEFORE words before or AFTER words after; a v
    without a target is any other word. A state holds the words since a target and, on a path that counts on one to come, the
    words left for it: such a path ends without one."""
    out: Arcs = {}
    for since in range(BEFORE + 1):
        for due in range(AFTER + 1):
            state = (since, due)
            arcs = out[state] = {}

            def go(gain: bool = False, since=since, due=due) -> list:
                if due == 1 and not gain:
                    return []
                return [(max(0, since - 1), max(0, due - 1))]

            for x in (*INSULTS, "t", "v"):
                seen, plain = [], "t" if x == "v" else x
                for n in go():
                    base = THREAT if x == "v" else 0
                    if since:
                        seen.append((plain, base + TARGETED * (_weight(plain)), n))
                    else:
                        seen.append(("o" if x == "v" else x, 0.0, n))
                        seen.append((plain, base + TARGETED * _weight(plain), (n[0], n[1] or AFTER)))
                arcs[x] = seen
            for x in ("n", "r", "o"):
                arcs[x] = [(x, 0.0, n) for n in go()]
            arcs["y"] = [("y", 0.0, (BEFORE, 0))]
            arcs[END] = [] if due else [("o", 0.0, (0, 0))]
    names = {s: k for k, s in enumerate(out)}
    return {names[s]: {x: [(o, w, names[n]) for o, w, n in steps] for x, steps in arcs.items()} for s, arcs in out.items()}


def negations() -> Arcs:
    """Insults and threats lose a share of their weight in the NEGATED words after n."""
    out: Arcs = {}
    for left in range(NEGATED + 1):
        out[left] = {x: [(x, -DENIED * _weight(x) if left else 0.0, NEGATED if x == "n" else max(0, left - 1))] for x in SIGNS}
    return out


def reports() -> Arcs:
    """Insults and threats lose a share of their weight from r to the end of the clause."""
    return {s: {x: [(x, -QUOTED * _weight(x) if s else 0.0, 1 if x == "r" else s)] for x in SIGNS} for s in (0, 1)}


class Grammar:
    """The composed transducer and the lexicon before it."""

    def __init__(self, entries: dict[str, float]):
        import ahocorasick

        self.entries = {e: max(1, min(LEVELS, round(w))) for e, w in entries.items()}
        self.classes = {w: c for c, words in CLASSES.items() for w in words.split()}
        self.arcs = compose(compose(compose(threats(), targets()), negations()), reports())
        self.automaton = ahocorasick.Automaton()
        for term in {*(e.rstrip("$") for e in entries), *CLASSES["v"].split()}:  # whole words too; insult() checks where they end
            self.automaton.add_word(term, len(term))
        self.automaton.make_automaton()

    def insult(self, word: str) -> int:
        """The level of the word, or of its longest beginning that is an entry."""
        if (got := self.entries.get(f"{word}$")) is not None:
            return got
        for n in range(min(len(word), LONGEST), SHORTEST - 1, -1):
            if (got := self.entries.get(word[:n])) is not None:
                return got
        return 0

    def symbols(self, word: str) -> list[tuple[str, float]]:
        """What the lexicon transducer makes of a word: symbols with weights."""
        own = self.classes.get(word, "o")
        out = [(own, 0.0)]
        if level := self.insult(word) if own == "o" else 0:
            out.append((f"i{level}", float(level)))
        elif own == "v":
            out.append(("o", 0.0))
        return out

    def clause(self, words: list[str]) -> float:
        """The weight of the best path."""
        best: dict[object, float] = {0: 0.0}
        for choices in [*map(self.symbols, words), [(END, 0.0)]]:
            after: dict[object, float] = {}
            for state, held in best.items():
                for symbol, w in choices:
                    for _, v, n in self.arcs[state][symbol]:
                        if after.get(n, -1.0) < held + w + v:
                            after[n] = held + w + v
            best = after
        return max(best.values(), default=0.0)

    def features(self, text: str) -> list[float]:
        """From the scores of the matched clauses: log-scaled total, best, log-scaled number and total by length; and length."""
        low, n = text.lower(), len(text)
        marked = sorted({end - size + 1 for end, size in self.automaton.iter(low) if not low[end - size].isalpha() or end - size < 0}) if low.strip() else []
        total = top = 0.0
        clauses = 0
        if marked:
            stops = [m.start() for m in CLAUSE.finditer(low)] + [n + len(low)]
            last = -1
            for at in marked:
                k = bisect_left(stops, at)
                if k == last:
                    continue
                last = k
                score = self.clause(WORD.findall(low[stops[k - 1] if k else 0 : stops[k]]))
                if score > 0:
                    total, top, clauses = total + score, max(top, score), clauses + 1
        size = 1 + n / 400
        return [math.log1p(total), top, math.log1p(clauses), math.log1p(10 * total / size), math.log(size)]


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_rows(docs: DataFrame, labels: DataFrame, max_labelled: int) -> DataFrame:
    """text, toxic and part of at most max_labelled rows that may be learned from; copies of a text count once. A table of so few
    rows is written by a task for each 1,000 of them at most, whatever the number of shuffle partitions: every file costs the
    executor processes of its own."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.filter(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    rows = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(known), "doc_id")
    part = F.pmod(F.xxhash64("text"), F.lit(3)).cast("int").alias("part")
    once = rows.groupBy("text").agg(F.max("toxic").cast("int").alias("toxic")).select("text", "toxic", part)
    return materialise(once.coalesce(max(1, max_labelled // 1000)), "labelled")


def _terms(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return {f"{w}$" for w in words if len(w) > 2} | {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def learn_entries(rows: DataFrame, least: int = 3) -> dict[str, float]:
    """Entries with their weights: log odds of a document's being toxic, less two standard errors, by document counts. Their
    number is bounded by the terms of the labelled rows, whose number is a parameter."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts_by_slice(batches):
            bad, good = Counter(), Counter()
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                (bad if toxic else good).update(_terms(text))
            names = [*(bad.keys() | good.keys())]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([bad[x] for x in names], pa.int64()), pa.array([good[x] for x in names], pa.int64())], names=["term", "bad", "good"])

    n1, n0 = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    if not n1 or not n0:
        return {}
    t = rows.select("text", "toxic").mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("a"), F.sum("good").alias("b")).filter(F.col("a") >= least)
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1)) - 2 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    got = {r["term"]: r for r in t.withColumn("w", odds).filter("w > 1").collect()}
    # a beginning that only one longer beginning has is that one
    short = {x[:-1] for x, r in got.items() if x[-1] != "$" and (s := got.get(x[:-1])) and (s["a"], s["b"]) == (r["a"], r["b"])}
    return {x: r["w"] for x, r in got.items() if x not in short}


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights of a penalised logistic regression, the constant last, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = penalty * np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    def __init__(self, entries: dict[str, float], weights: list[float]):
        self.entries, self.weights = entries, weights


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = 9000) -> Model:
    rows = labelled_rows(docs, labels, max_labelled)
    entries = learn_entries(rows.filter("part < 2"))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(entries)
        for batch in texts_by_slice(batches):
            yield pa.RecordBatch.from_arrays([pa.array([grammar.features(t) for t in batch.column("text").to_pylist()], pa.list_(pa.float64())), batch.column("toxic")], names=["x", "toxic"])

    got = rows.filter("part = 2").select("text", "toxic").mapInArrow(describe, "x array<double>, toxic int").collect()
    if not entries or not got:
        return Model({}, [])
    return Model(entries, fit(np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float)).tolist())


def scorer(model: Model) -> Callable[[Iterator[str | None]], list[float]]:
    """A function from texts to scores; the grammar is built once."""
    if not model.weights:
        return lambda texts: [0.0 for _ in texts]
    grammar, w = Grammar(model.entries), np.array(model.weights)

    def scores(texts: Iterator[str | None]) -> list[float]:
        x = np.array([grammar.features(t or "") for t in texts]).reshape(-1, len(w) - 1)
        return (1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))).tolist()

    return scores


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = scorer(model)
        for batch in batches:
            # one text at a time is a Python object, however large the batch
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(x.as_py() for x in batch.column("text")), pa.float64())], names=["doc_id", "score"])
            del batch
            trim()

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose score is under 0.5, with all their columns."""
    names = docs.columns
    plain = docs.toDF(*[f"c{k}" for k in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, at = scorer(model), names.index("text")
        for batch in batches:
            yield batch.filter(pa.array([s < 0.5 for s in scores(x.as_py() for x in batch.column(at))], pa.bool_()))
            del batch
            trim()

    return plain.mapInArrow(run, plain.schema).toDF(*names)
