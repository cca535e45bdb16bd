"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words fall into classes: insult, threat, target, negation, report, other. The grammar composes a transducer for each:
negation turns an insult or threat within three words after it into a denied one, reported speech turns one after a verb of
saying into a quoted one, targets mark one in a clause that addresses somebody, and insults and threats pay out the weight of
each kind. A matched clause scores the sum of what its path pays, times the matched words' own weights. Only clauses with an
insult or threat can pay, so only those are read by the grammar; they are found by one automaton over the whole text.

Insults are learned: stems (the first 3 to 8 letters of words, and whole words) that toxic labelled documents have and others
don't, weighted by log-odds. Inflected words share their stem, so stems are taken as short as their precision allows. Copies
of a document count once, by minima of shingle hashes. A logistic model of the clause scores gives the score.

Learning reads at most `SAMPLE` labelled documents of each label, those with the smallest hash of doc_id, and of rows that share
a doc_id the smallest text; scoring reads all.

Edge cases: null and empty texts match nothing and have the score of a clean text, below one half; null labels teach nothing; repeated rows
are scored alike; without labelled rows, or with one label only, a built-in list of insults is used; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import product
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillveil.llm.text import mix, shingle_sets
from quillveil.llm.workers import lean

#: Labelled documents of each label that learning reads at most.
SAMPLE = 3000
STEM = range(3, 9)
#: Log-odds, at most, of a text in which nothing matches: without evidence a text is not toxic, whatever labels prevail.
UNMATCHED = -0.5
THREATS = ("kill you", "hurt you", "beat you", "find you", "burn you", "shoot you", "hunt you", "destroy you", "tue dich", "bring dich um", "te mataré", "te tuer")
INSULTS = ("idiot", "moron", "stupid", "scum", "trash", "loser", "pathetic", "worthless", "disgusting", "clown")
TARGETS = frozenset("you your yours yourself he she they them him her u du dich dir ihr euch sie tu te toi vous il elle ils tú usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't nor nicht kein keine nie pas jamais aucun non nunca ningún".split())
REPORTS = frozenset("said says say called calls wrote writes quoted claims claimed according sagte schrieb nannte dit écrit appelé dijo escribió llamó".split())
_CLASSES = "ihunro"  # insult, threat, target, negation, report, other
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_BREAK = re.compile(r"[.!?;\n]")


class Transducer(NamedTuple):
    """Deterministic: (state, input) to (state, output, weight); a missing arc keeps the state and passes the symbol on."""

    arcs: dict[tuple[object, str], tuple[object, str, float]]
    start: object = 0

    def step(self, state: object, symbol: str) -> tuple[object, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 0.0))

    def run(self, symbols: str) -> list[float]:
        state, out = self.start, []
        for s in symbols:
            state, _, w = self.step(state, s)
            out.append(w)
        return out


def compose(a: Transducer, b: Transducer, alphabet: str) -> Transducer:
    """The transducer that feeds a's output to b; weights add."""
    arcs, seen, todo = {}, {(a.start, b.start)}, [(a.start, b.start)]
    while todo:
        p, q = todo.pop()
        for s in alphabet:
            p2, mid, w = a.step(p, s)
            q2, out, v = b.step(q, mid)
            arcs[(p, q), s] = ((p2, q2), out, w + v)
            if (p2, q2) not in seen:
                seen.add((p2, q2))
                todo.append((p2, q2))
    return Transducer(arcs, (a.start, b.start))


def negation(reach: int = 3) -> Transducer:
    arcs = {(k, "n"): (reach, "o", 0.0) for k in range(reach + 1)}
    for k in range(1, reach + 1):
        arcs |= {(k, s): (k - 1, s, 0.0) for s in "uro"} | {(k, "i"): (0, "d", 0.0), (k, "h"): (0, "d", 0.0)}
    return Transducer(arcs)


def reported() -> Transducer:
    return Transducer({(0, "r"): (1, "o", 0.0), (1, "r"): (1, "o", 0.0), (1, "i"): (1, "q", 0.0), (1, "h"): (1, "q", 0.0)})


def targeted() -> Transducer:
    return Transducer({(0, "u"): (1, "u", 0.0), (1, "i"): (1, "I", 0.0), (1, "h"): (1, "H", 0.0)})


def insult() -> Transducer:
    return Transducer({(0, "i"): (0, "i", 1.0), (0, "I"): (0, "I", 1.5), (0, "d"): (0, "d", 0.1), (0, "q"): (0, "q", 0.4)})


def threat() -> Transducer:
    return Transducer({(0, "h"): (0, "h", 1.5), (0, "H"): (0, "H", 2.5)})


@lru_cache(1)
def grammar() -> Transducer:
    out = negation()
    for other in (reported(), targeted(), insult(), threat()):
        out = compose(out, other, _CLASSES)
    return out


class Model(NamedTuple):
    stems: dict[str, float]
    whole: dict[str, float]
    coefficients: tuple[float, ...]


class Reader:
    """Finds the clauses with insults or threats and has the grammar weigh them."""

    def __init__(self, model: Model):
        self.automaton = ahocorasick.Automaton()
        self.weights: dict[str, tuple[str, float, bool]] = {x: ("h", 1.0, False) for x in THREATS}
        self.weights |= {x: ("i", w, True) for x, w in model.whole.items()} | {x: ("i", w, False) for x, w in model.stems.items()}
        for x in self.weights:
            self.automaton.add_word(x, x)
        self.automaton.make_automaton()

    def events(self, text: str) -> dict[int, tuple[str, float]]:
        """Start of each matched word: its class and weight; the heaviest, if several entries match."""
        out: dict[int, tuple[str, float]] = {}
        if not self.weights:
            return out
        for end, entry in self.automaton.iter(text):
            start = end - len(entry) + 1
            if start and text[start - 1].isalnum():
                continue
            kind, weight, whole = self.weights[entry]
            if whole and end + 1 < len(text) and text[end + 1].isalnum():
                continue
            if start not in out or out[start][1] < weight:
                out[start] = (kind, weight)
        return out

    def features(self, text: str) -> tuple[float, float, float]:
        """Sum of the clause scores, the largest, and their sum by the square root of the text's words."""
        text = text.lower()
        events = self.events(text)
        if not events:
            return 0.0, 0.0, 0.0
        total = most = 0.0
        starts = sorted(events)
        i = b = 0
        while i < len(starts):
            at = starts[i]
            a = max(b, *(text.rfind(c, b, at) + 1 for c in ".!?;\n"))
            m = _BREAK.search(text, at)
            b = max(m.start() if m else len(text), at + 1)
            symbols, weights = [], []
            for w in _WORD.finditer(text, a, b):
                kind, weight = events.get(w.start(), (None, 0.0))
                if kind is None:
                    word = w[0]
                    kind = "u" if word in TARGETS else "n" if word in NEGATIONS else "r" if word in REPORTS else "o"
                symbols.append(kind)
                weights.append(weight)
            score = sum(p * w for p, w in zip(grammar().run("".join(symbols)), weights, strict=True))
            total, most = total + score, max(most, score)
            while i < len(starts) and starts[i] < b:
                i += 1
        return total, most, total / (1 + text.count(" ")) ** 0.5


def _inputs(features: np.ndarray) -> np.ndarray:
    return np.column_stack((np.ones(len(features)), np.log1p(np.maximum(features, 0))))


def probability(features: np.ndarray, coefficients: tuple[float, ...]) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(_inputs(features) @ np.array(coefficients), -30, 30)))


def _fit(features: np.ndarray, labels: np.ndarray, ridge: float = 1.0, constant: float | None = None) -> tuple[float, ...]:
    """Logistic regression by Newton steps, its constant fixed if one is given."""
    x, w = _inputs(features), np.zeros(features.shape[1] + 1)
    if constant is not None:
        w[0] = constant
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        penalty = np.r_[1e-3, np.full(features.shape[1], ridge)]
        gradient = x.T @ (p - labels) + penalty * w
        if constant is not None:
            gradient[0], penalty[0] = 0, 1e12
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def _stems(text: str) -> set[str]:
    out = set()
    for word in set(_WORD.findall(text.lower())):
        out.update(word[:n] for n in STEM if n < len(word))
        out.add(word + "$")
    return out


def _copy_keys(shingles: np.ndarray) -> list[int]:
    """Four minima of hash orders; near copies share one of them."""
    return [int((mix(shingles + np.uint64(k)) if k else shingles).min()) ^ k for k in range(4)] if len(shingles) else [-1]


def learn(texts: list[str], labels: list[int], least: float = 0.006, odds: float = 3.0) -> Model:
    """The model of labelled texts. A stem must occur in a share `least` of the toxic texts, in 4 at least, and have log-odds
    of `odds` at least."""
    default = Model({}, {x: 3.0 for x in INSULTS}, (-2.0, 1.0, 1.0, 1.0))
    known: set[tuple[int, int]] = set()
    sides: tuple[list[str], list[str]] = ([], [])
    for text, y, own in zip(texts, labels, shingle_sets(pa.array(texts, pa.large_string())), strict=True):
        keys = {(y, k) for k in _copy_keys(own)}
        if not keys & known:
            sides[y].append(text)
        known |= keys
    clean, toxic = sides
    if not toxic or not clean:
        return default
    seen = Counter(s for t in toxic for s in _stems(t))
    seen = {s: n for s, n in seen.items() if n >= max(4, least * len(toxic))}
    against = Counter(s for t in clean for s in _stems(t) if s in seen)
    weight = {s: np.log((n + 0.5) / (len(toxic) + 1)) - np.log((against[s] + 0.5) / (len(clean) + 1)) for s, n in seen.items()}
    good = [s for s in seen if weight[s] >= odds and seen[s] >= 9 * against[s] * max(1.0, len(toxic) / len(clean))]
    good.sort(key=lambda s: (-seen[s] * weight[s], len(s), s))
    stems: dict[str, float] = {}
    whole: dict[str, float] = {}
    for s in good:
        word = s.rstrip("$")
        if any(word[:n] in stems for n in STEM) or word in whole:
            continue
        if s.endswith("$"):
            whole[word] = float(min(weight[s], 6.0))
        else:
            stems[s] = float(min(weight[s], 6.0))
    model = Model(stems, whole, default.coefficients)
    reader = Reader(model)
    both = toxic + clean
    features = np.array([reader.features(t) for t in both])
    targets = np.r_[np.ones(len(toxic)), np.zeros(len(clean))]
    coefficients = _fit(features, targets)
    return model._replace(coefficients=coefficients if coefficients[0] <= UNMATCHED else _fit(features, targets, constant=UNMATCHED))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from labelled documents that are not held out: the `sample` of each label with the smallest hash."""
    rows = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = None
    for y in (0, 1):
        part = rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        chosen = part if chosen is None else chosen.unionByName(part)
    found = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text is not null").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).collect()
    found.sort(key=lambda r: r["doc_id"])
    return learn([r["text"] for r in found], [r["toxic"] for r in found])


@lru_cache(4)
def _reader(stems: tuple, whole: tuple) -> Reader:
    return Reader(Model(dict(stems), dict(whole), ()))


def score(documents: DataFrame, model: Model, text: str = "text", out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """documents with the columns that `out` names: the score, and whether it is at least one half; they replace any of those names."""
    names = [c for c in documents.columns if c not in out]
    stems, whole, coefficients = tuple(model.stems.items()), tuple(model.whole.items()), model.coefficients

    def run(batches):
        reader = _reader(stems, whole)
        for batch in batches:
            found = np.array([reader.features(t or "") for t in batch.column(0).to_pylist()]).reshape(-1, 3)
            p = probability(found, coefficients)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*names, *out])

    schema = T.StructType([*(documents.schema[c] for c in names), T.StructField(out[0], T.DoubleType()), T.StructField(out[1], T.IntegerType())])
    return documents.select(F.col(text).cast("string").alias("\0text"), *(F.col(f"`{c}`") for c in names)).mapInArrow(lean(run), schema)
