"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer reads words and writes symbols: insult, threat, target, negation, reported speech. Three context
transducers read those symbols in turn and are composed with each other: the negation transducer marks insults and
threats in the scope of a negation, the report transducer those after a reporting verb, the target transducer those
after a person who is meant. The composed machine runs over each clause in which the lexicon finds an insult or threat;
as the person is as often named later ("I will kill you"), the target transducer then runs over what it wrote from the
clause's end to its beginning. Each insult or threat has a weight and a context then; so clauses are scored, not words
by themselves.

The insult lexicon has words and beginnings of words with weights, learned from labelled documents (with a few fixed
English words for a start); a logistic regression over the clause scores by context gives a document's score.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalog.llm._common import column, prepare, python_texts, release_memory, tidied

#: Bounds of the labelled sample that is learned from: documents of each class, by order of their id's hash, and
#: code points of one (longer ones are not learned from). Scores are always of whole texts.
TRAIN_ROWS, TRAIN_CHARS = 3000, 20_000
#: Entries of the learned lexicon at most, those that tell the classes apart best.
LEXICON = 300
#: Lengths of word beginnings that may be entries.
PREFIXES = range(3, 9)

#: Seed words.
INSULTS = ["asshole", "bastard", "bitch", "clown", "cretin", "disgusting", "dumb", "filth", "freak", "idiot", "imbecile", "loser", "moron", "pathetic", "pig", "retard", "scum", "stupid", "trash", "ugly", "vermin", "worthless"]
THREATS = ["kill", "destroy", "hurt", "murder", "strangle", "burn", "shoot", "stab", "töten", "umbringen", "tuer", "matar"]
TARGETS = ["you", "your", "they", "them", "he", "she", "him", "her", "these", "those", "people", "du", "dich", "ihr", "sie", "tu", "toi", "vous", "ils", "tú", "usted", "ellos"]
NEGATIONS = ["not", "never", "no", "neither", "nor", "isn't", "aren't", "wasn't", "don't", "nicht", "kein", "keine", "nie", "pas", "jamais", "ni", "nunca"]
REPORTS = ["said", "says", "say", "called", "claims", "claimed", "reported", "quoted", "wrote", "according", "sagte", "sagt", "dit", "dijo"]

_WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
_CLAUSE_END = re.compile(r"[.!?;\n]")


class Transducer:
    """Deterministic transducer over symbols: arcs (state, symbol) -> (state, symbol written); others copy and stay,
    or go where ``otherwise`` says."""

    def __init__(self, start, arcs: dict, otherwise=None) -> None:
        self.start, self.arcs, self.otherwise = start, arcs, otherwise or (lambda s: s)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (self.otherwise(state), symbol)

    def compose(self, then: Transducer) -> Transducer:
        """The machine that feeds what this one writes to another; its states are found as they are reached."""
        outer = self

        class Composed(Transducer):
            def step(self, state, symbol):
                if (state, symbol) not in self.arcs:
                    a, written = outer.step(state[0], symbol)
                    b, written = then.step(state[1], written)
                    self.arcs[state, symbol] = ((a, b), written)
                return self.arcs[state, symbol]

        return Composed((self.start, then.start), {})

    def run(self, symbols: Sequence[str]) -> list[str]:
        state, out = self.start, []
        for s in symbols:
            state, w = self.step(state, s)
            out.append(w)
        return out


def negation_scope(width: int = 3) -> Transducer:
    """Insults (I) and threats (H) within ``width`` words after a negation (N) are negated (i, h)."""
    arcs = {(k, "N"): (width, "N") for k in range(width + 1)}
    for k in range(1, width + 1):
        arcs |= {(k, "I"): (k - 1, "i"), (k, "H"): (k - 1, "h")}
    return Transducer(0, arcs, lambda k: max(0, k - 1))


def report_scope() -> Transducer:
    """After a report (R) insults and threats to the clause's end are reported (r), negated or not."""
    arcs = {(s, "R"): (1, "R") for s in (0, 1)} | {(1, x): (1, "r") for x in "IHih"}
    return Transducer(0, arcs)


def target_scope(width: int = 4) -> Transducer:
    """Insults and threats within ``width`` words after a target (T), in reading order, are targeted (t, x)."""
    arcs = {(k, "T"): (width, "T") for k in range(width + 1)}
    for k in range(1, width + 1):
        arcs |= {(k, "I"): (k - 1, "t"), (k, "H"): (k - 1, "x")}
    return Transducer(0, arcs, lambda k: max(0, k - 1))


def grammar() -> Transducer:
    """The composed machine, which reads a clause from left to right."""
    return negation_scope().compose(report_scope()).compose(target_scope())


class Scopes:
    """Two passes over a clause: the composed machine, then the scope of targets from right to left."""

    def __init__(self) -> None:
        self.ahead, self.back = grammar(), target_scope()

    def run(self, symbols: Sequence[str]) -> list[str]:
        return self.back.run(self.ahead.run(symbols)[::-1])[::-1]


#: Contexts that the grammar writes, and how much of a weight counts in a clause's score. A threat without a target
#: (H) is none.
CONTEXTS = {"I": 1.0, "t": 1.2, "x": 1.5, "i": 0.5, "h": 0.2, "r": 0.6, "H": 0.0}


def _trie_pattern(words: Sequence[str]) -> str:
    trie: dict = {}
    for w in words:
        node = trie
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def of(node: dict) -> str:
        ends = "" in node
        kids = [re.escape(c) + of(n) for c, n in sorted(node.items()) if c]
        if not kids:
            return ""
        body = kids[0] if len(kids) == 1 and not ends else f"(?:{'|'.join(kids)})"
        return body + ("?" if ends else "")

    return of(trie)


@dataclass
class Model:
    """A lexicon (entries ending in $ are whole words, others beginnings) and the weights of the document's features."""

    lexicon: dict[str, float]
    weights: list[float] = field(default_factory=lambda: [-4.0, 1.0, 0.5, 0.5, 0.0, 0.0])
    mean: list[float] = field(default_factory=lambda: [0.0] * 5)
    scale: list[float] = field(default_factory=lambda: [1.0] * 5)

    def matcher(self) -> Matcher:
        return Matcher(self)


class Matcher:
    """The compiled machine of a model."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.machine = Scopes()
        self.kinds = {w: k for k, words in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)) for w in words}
        self.threats = set(THREATS)
        keys = sorted({k.rstrip("$") for k in model.lexicon} | self.threats)
        self.finder = re.compile(rf"\b(?:{_trie_pattern(keys)})") if keys else re.compile(r"(?!)")
        self.deepest = max(map(len, keys), default=0)

    def weight(self, word: str) -> tuple[str, float]:
        """The symbol and weight that the lexicon transducer writes for a word: whole words first, then the longest beginning."""
        lexicon = self.model.lexicon
        if (w := lexicon.get(word + "$")) is not None:
            return word + "$", w
        for n in range(min(len(word), self.deepest), 0, -1):
            if (w := lexicon.get(word[:n])) is not None:
                return word[:n], w
        return "", 0.0

    def features(self, text: str) -> list[float]:
        """Of the scored clauses: the largest score, log of their sum and number, distinct entries, weight for each word."""
        text = text.lower()
        hits = [m.start() for m in self.finder.finditer(text)]
        if not hits:
            return [0.0] * 5
        ends = [m.start() for m in _CLAUSE_END.finditer(text)]
        scores, entries, done = [], set(), -1
        for at in hits:
            if at < done:
                continue
            k = bisect_left(ends, at)
            start, end = (ends[k - 1] + 1 if k else 0), (ends[k] if k < len(ends) else len(text))
            done = end
            words = _WORD.findall(text, start, end)
            symbols, weights = [], []
            for w in words:
                entry, weight = self.weight(w)
                kind = self.kinds.get(w, "O")
                if entry and weight > 0:
                    kind = "I"
                    entries.add(entry)
                elif w in self.threats:
                    kind, weight = "H", 2.0
                symbols.append(kind)
                weights.append(weight)
            score = sum(CONTEXTS[s] * w for s, w in zip(self.machine.run(symbols), weights, strict=True) if s in CONTEXTS)
            if score > 0:
                scores.append(score)
        if not scores:
            return [0.0] * 5
        total = sum(scores)
        return [max(scores), math.log1p(total), math.log1p(len(scores)), math.log1p(len(entries)), math.log1p(1000 * total / max(20, len(text) / 6))]

    def score(self, text: str) -> float:
        m = self.model
        z = m.weights[0] + sum(w * (f - a) / s for w, f, a, s in zip(m.weights[1:], self.features(text), m.mean, m.scale, strict=True))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _entries(text: str) -> set[str]:
    out = set()
    for w in set(_WORD.findall(text.lower())):
        if len(w) >= 3 and not w.isdigit():
            out.add(w + "$")
            out.update(w[:n] for n in PREFIXES if n <= len(w))
    return out


def learn_lexicon(toxic: Sequence[set[str]], clean: Sequence[set[str]], size: int = LEXICON) -> dict[str, float]:
    """Entries that tell toxic from clean documents, weighted by the logarithm of their odds."""
    n, m = len(toxic), len(clean)
    seeds = {f"{w}$": 3.0 for w in INSULTS}
    if not n or not m:
        return seeds
    inside = Counter(e for d in toxic for e in d)
    wanted = {e for e, c in inside.items() if c >= 3}
    outside = Counter(e for d in clean for e in d if e in wanted or e in seeds)
    found: dict[str, tuple[float, float]] = {}
    for e in wanted:
        a, b = inside[e], outside[e]
        rate_a, rate_b, rate = a / n, b / m, (a + b) / (n + m)
        weight = math.log(((a + 0.5) / (n + 1)) / ((b + 0.5) / (m + 1)))
        if weight < 1.0:
            continue
        part = lambda k, t, p: (k * math.log(p / rate) if k else 0.0) + ((t - k) * math.log((1 - p) / (1 - rate)) if t > k and rate < 1 else 0.0)
        gain = 2 * (part(a, n, rate_a) + part(b, m, rate_b))
        if gain >= 15:
            found[e] = (gain, weight)
    kept: dict[str, float] = {}
    for e in sorted(found, key=lambda x: (-found[x][0], len(x), x)):
        if len(kept) >= size:
            break
        stem = e.rstrip("$")
        shorter = [found[stem[:k]][1] for k in range(min(PREFIXES), len(stem) + (e != stem)) if stem[:k] in kept]
        if shorter and max(shorter) >= found[e][1] - 0.5:
            continue  # a kept beginning says as much
        kept[e] = found[e][1]
    for e, w in seeds.items():
        if e not in kept and outside[e] <= inside[e] + 1:
            kept[e] = w
    return kept


def _fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> Model:
    mean, scale = np.average(x, 0, weight), np.sqrt(np.average((x - np.average(x, 0, weight)) ** 2, 0, weight)) + 1e-6
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + penalty
        step = np.linalg.solve(h, z.T @ (weight * (p - y)) + penalty @ w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return Model({}, w.tolist(), mean.tolist(), scale.tolist())


def train(rows: Sequence[tuple[str, int]], share: float | None = None, folds: int = 3) -> Model:
    """A model from (text, toxic) rows. ``share``: of toxic rows among all that the sample stands for.

    The document weights are fitted on features that a lexicon of the other folds gives, so they know how far a
    learned lexicon can be trusted on new texts.
    """
    y = np.array([int(t) for _, t in rows])
    if not len(y) or y.all() or not y.any():
        return Model({f"{w}$": 3.0 for w in INSULTS}, [-3.0, 1.0, 1.0, 0.5, 0.5, 0.0])
    # Only what three toxic documents have, or a seed, can be an entry; the rest isn't kept.
    often = Counter(e for t, c in rows if c for e in _entries(t))
    known = {e: e for e in [*(e for e, n in often.items() if n >= 3), *(f"{w}$" for w in INSULTS)]}
    del often
    entries = [{known[e] for e in _entries(t) if e in known} for t, _ in rows]
    fold = np.zeros(len(y), int)
    for c in (0, 1):
        own = np.flatnonzero(y == c)
        fold[own] = np.arange(len(own)) % folds
    x = np.zeros((len(y), 5))
    for f in range(folds):
        own = Matcher(Model(learn_lexicon([e for e, t, g in zip(entries, y, fold, strict=True) if t and g != f], [e for e, t, g in zip(entries, y, fold, strict=True) if not t and g != f])))
        for i in np.flatnonzero(fold == f):
            x[i] = own.features(rows[i][0])
    share = y.mean() if share is None else share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model = _fit(x, y, weight)
    model.lexicon = learn_lexicon([e for e, t in zip(entries, y, strict=True) if t], [e for e, t in zip(entries, y, strict=True) if not t])
    return model


def held_out(key, folds: int = 5):
    """Rows that labels aren't learned from: crc32 of the key as text has remainder 0."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> tuple[list[tuple[str, int]], float | None]:
    """A bounded sample of labelled texts, and the share of toxic ones among all labels that may be used."""
    usable = labels.select(column(labels, "doc_id").alias("label_id"), column(labels, "toxic").cast("int").alias("toxic_label")).where("label_id is not null and toxic_label in (0, 1)").where(~held_out(F.col("label_id")))
    n = {r[0]: r[1] for r in usable.groupBy("toxic_label").count().collect()}
    picked = None
    for c in (0, 1):
        part = usable.where(F.col("toxic_label") == c).orderBy(F.xxhash64("label_id"), "label_id").limit(rows)
        picked = part if picked is None else picked.unionAll(part)
    texts = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text")).where(F.col("text").isNotNull() & (F.length("text") <= chars))
    found = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", "toxic_label").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(2 * rows).collect()
    return [(r[1], r[2]) for r in found], n.get(1, 0) / sum(n.values()) if n else None


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model that the usable labels give; the driver keeps nothing else of the sample."""
    model = train(*training_rows(docs, labels))
    release_memory()
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """Per row: doc_id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on). Only the text is judged, and
    all of it, however long; null texts are empty and get the score of a text without any match. Repeated rows are
    scored each; an empty table gives an empty result; columns beside doc_id and text, whatever their names, aren't read."""
    prepare(docs.sparkSession)
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([matcher.score(t) for t in python_texts(batch.column(1))], pa.float64())], ["doc_id", "score"])

    got = rows.mapInArrow(tidied(scored), f"doc_id {kind}, score double")
    return got.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from the labels that may be used and score all of ``docs``."""
    return score_documents(docs, learned(docs, labels))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``docs`` without those whose score reaches the threshold; columns, whatever their names, unchanged. Null texts
    are empty and stay, as do all copies of a row that stays; an empty table stays empty."""
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = model.matcher()
        for batch in batches:
            yield batch.filter(pa.array([matcher.score(t) < threshold for t in python_texts(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(tidied(kept), docs.schema)
