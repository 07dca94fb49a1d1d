"""Toxicity by a weighted finite-state pattern grammar.

Words of a sentence become seven classes. Five small transducers read them side by side: insult, threat,
target, negation and reported speech. They are composed once into a deterministic table; a run over a
sentence puts out what each insult or threat word is worth there: an arc's weight is the product of the
parts' weights, so what is denied or only reported weighs less, and what is aimed at somebody more.
Reported speech also reaches back over a quotation ("...", she said), which a second run from the right
finds. The sums over sentences feed a logistic score; single words count only through their sentence.

The insult words are learned: words and word beginnings that mark toxic documents in the labelled
sample, chosen greedily until every toxic document is covered twice. Seed words are there beside them.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathquarry.llm.common import forget, held_out, texts_of, written
from mathquarry.llm.labelled import labelled_sample, scorer

#: The training sample is of so many labelled documents at most, and so many words and beginnings are looked at closely.
SAMPLE, CANDIDATES = 12_000, 4000
FLAG = 0.3
PREFIXES = (4, 5, 6, 7, 8)

# Seed words of each class, in English, German, French and Spanish.
SEED_INSULTS = (
    "idiot idiots moron morons stupid loser losers scum worthless pathetic disgusting imbecile dumbass bastard asshole "
    "dummkopf trottel arschloch vollidiot abschaum connard imbécile salaud idiota imbécil estúpido estúpida cabrón"
).split()
THREATS = "kill hurt murder strangle stab shoot destroy beat umbringen töten schlagen tuer frapper matar golpear".split()
TARGETS = "you your yourself he him she her they them these those people du dich dir ihr euch tu toi te vous tú ti usted ustedes vosotros".split()
NEGATIONS = "not no never neither nor don't doesn't didn't isn't aren't wasn't nicht kein keine nie niemals pas jamais aucun nunca jamás ningún".split()
REPORTED = "said says say called calls wrote writes quoted reported according claims sagte sagt schrieb nannte laut dit disait écrit selon dijo dice escribió según".split()

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE = range(7)
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[\"“”„«»]")
_END = re.compile(r"[.;!?\n\r]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_QUOTES = frozenset("\"“”„«»")

#: Words that a negation and a verb of reporting reach.
DENIED, SAID = 3, 24
#: Arc weights: of an insult or threat word when it is denied, reported, or aimed at somebody named before in the sentence.
WEIGHT_DENIED, WEIGHT_REPORTED, WEIGHT_AIMED, WEIGHT_THREAT = 0.2, 0.4, 1.5, 3.0


def _countdown(start: int, reach: int) -> dict:
    """Class ``start`` opens a scope of ``reach`` words."""
    words = (OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT)
    return {(s, c): (reach if c == start else s - 1, 1.0) for s in range(reach + 1) for c in words if s or c == start}


# Transducers: (state, class) -> (state, weight); what is not listed stays, at weight 1.
_INSULT = {(0, INSULT): (1, 1.0)}
_THREAT = {(0, THREAT): (1, 1.0), (1, TARGET): (0, WEIGHT_THREAT), (1, NEGATION): (0, 1.0), (1, INSULT): (0, WEIGHT_THREAT)}
_TARGET = {(0, TARGET): (1, 1.0), (1, INSULT): (1, WEIGHT_AIMED)}
_NEGATION = _countdown(NEGATION, DENIED) | {(s, c): (s - 1, WEIGHT_DENIED) for s in range(1, DENIED + 1) for c in (INSULT, TARGET)}
_REPORT = _countdown(REPORT, SAID) | {(s, c): (s - 1, WEIGHT_REPORTED) for s in range(1, SAID + 1) for c in (INSULT, TARGET)}
PARTS = (_INSULT, _THREAT, _TARGET, _NEGATION, _REPORT)


def composed() -> tuple[list[list[int]], list[list[float]], list[tuple[int, ...]]]:
    """The product of the five transducers, reachable states only: moves, weights put out, and what each state is made of.

    An arc puts something out where an insult stands or a threat finds its target; its weight is the product of the parts'.
    """
    states = [(0,) * len(PARTS)]
    number, moves, weights = {states[0]: 0}, [], []
    for state in states:
        moves.append([])
        weights.append([])
        for c in range(7):
            steps = [part.get((s, c), (s, 1.0)) for part, s in zip(PARTS, state, strict=True)]
            after = tuple(s for s, _ in steps)
            if after not in number:
                number[after] = len(states)
                states.append(after)
            said = c == INSULT or c == TARGET and state[1] == 1
            moves[-1].append(number[after])
            weights[-1].append(math.prod(w for _, w in steps) if said else 0.0)
    return moves, weights, states


MOVES, WEIGHTS, STATES = composed()
N_FEATURES = 4


def sentence_weights(kinds: list[int], worth: list[float]) -> list[float]:
    """What each word of a sentence puts out: the composed transducer's weight, times ``worth`` for an insult word."""
    out, state = [], 0
    for kind, w in zip(kinds, worth, strict=True):
        found = WEIGHTS[state][kind]
        out.append(found * w if kind == INSULT else found)
        state = MOVES[state][kind]
    if REPORT in kinds and QUOTE in kinds:
        # from the right: a verb of reporting reaches back over the quotation before it
        open_, late = False, False
        quotes = kinds.count(QUOTE)
        for k in range(len(kinds) - 1, -1, -1):
            if kinds[k] == QUOTE:
                open_ = late and not open_ and quotes > 1
                quotes -= 1
            elif kinds[k] == REPORT:
                late, open_ = True, False
            elif open_:
                out[k] *= WEIGHT_REPORTED
    return out


@dataclass
class ToxicModel:
    words: dict[str, float]
    prefixes: dict[str, float]
    beta: np.ndarray = field(default_factory=lambda: np.zeros(N_FEATURES + 1))

    def __post_init__(self):
        self._tree = None

    def __getstate__(self):
        return {**self.__dict__, "_tree": None}

    def _matches(self):
        if self._tree is None:
            self._tree = ahocorasick.Automaton()
            for unit in {*self.words, *self.prefixes, *THREATS}:
                self._tree.add_word(unit, len(unit))
            self._tree.make_automaton()
        return self._tree

    def weight(self, word: str) -> float:
        found = self.words.get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n:
                found = max(found, self.prefixes.get(word[:n], 0.0))
        return found

    def features(self, text: str) -> np.ndarray | None:
        """Sums over the text's sentences; None without an insult or threat."""
        low = text.lower().replace("’", "'")
        places = [end - n + 1 for end, n in self._matches().iter(low) if end - n < 0 or not low[end - n].isalpha()]
        if not places:
            return None
        cuts = [0, *(m.end() for m in _END.finditer(low)), len(low)]
        total = aimed = 0.0
        seen: dict[str, float] = {}
        for k in dict.fromkeys(bisect_right(cuts, p) - 1 for p in places):
            words = _WORD.findall(low[cuts[k] : cuts[k + 1]])
            worth = [self.weight(w) for w in words]
            kinds = [INSULT if x else QUOTE if w in _QUOTES else _CLASSES.get(w, OTHER) for w, x in zip(words, worth, strict=True)]
            found = sentence_weights(kinds, worth)
            weight = sum(found)
            if weight:
                total += weight
                aimed += weight * (TARGET in kinds)
                for word, kind, x, w in zip(words, kinds, found, worth, strict=True):
                    if x:
                        seen[word] = max(seen.get(word, 0.0), min(1.0, x / w) if kind == INSULT else 1.0)
        if not total:
            return None
        length = low.count(" ") + low.count("\n") + 1
        return np.array([math.log1p(total), math.log1p(aimed), min(sum(seen.values()), 4.0), math.log1p(100 * total / length)])

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.full(len(texts), 1 / (1 + math.exp(-self.beta[-1])))
        for i, text in enumerate(texts.to_pylist()):
            found = self.features(text) if text else None
            if found is not None:
                out[i] = 1 / (1 + math.exp(-max(-30.0, min(30.0, float(found @ self.beta[:-1] + self.beta[-1])))))
        return out


_CLASSES = {w: c for c, words in ((TARGET, TARGETS), (REPORT, REPORTED), (NEGATION, NEGATIONS), (THREAT, THREATS)) for w in words}


def units_of(text: str) -> set[str]:
    """Distinct words of three letters or more, and beginnings of longer ones: "x*", and "x**" where two words begin so."""
    words = {w for w in _LETTERS.findall(text.lower()) if len(w) >= 3}
    begun = Counter([w[:n] for w in words for n in PREFIXES if len(w) > n])
    return words | {x + "*" for x in begun} | {x + "**" for x, n in begun.items() if n > 1}


def cover(documents: list[list[int]], toxic: np.ndarray, clean: np.ndarray, stems: list[str], times: int = 2) -> list[int]:
    """Units chosen one by one, each time that which marks most toxic documents not yet marked ``times`` times.

    Clean documents count against a unit, and units that begin alike are chosen once.
    """
    need = np.full(len(documents), times)
    holds: list[list[int]] = [[] for _ in toxic]
    for d, units in enumerate(documents):
        for u in units:
            holds[u].append(d)
    holds = [np.array(h, dtype=np.int64) for h in holds]
    gain = np.array([float(len(h)) for h in holds])
    open_ = np.ones(len(toxic), dtype=bool)
    chosen: list[int] = []
    while len(chosen) < len(toxic):
        value = np.where(open_, gain * (1 - 4 * clean / np.maximum(toxic, 1)), -np.inf)
        u = int(np.argmax(value))
        if gain[u] < max(3, 0.004 * len(documents)) or value[u] <= 0:
            break
        chosen.append(u)
        for d in holds[u]:
            if need[d] > 0:
                need[d] -= 1
                if need[d] == 0:
                    gain[documents[d]] -= 1
        for v, stem in enumerate(stems):
            if stem.startswith(stems[u]) or stems[u].startswith(stem):
                open_[v] = False
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    ridge = np.diag([penalty] * (x.shape[1] - 1) + [0.01])
    beta = np.zeros(x.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
    return beta


def train_toxicity(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", rows: int = SAMPLE, units: int = CANDIDATES) -> ToxicModel:
    """Learn words, beginnings and weights from at most ``rows`` labelled documents, whole ones.

    Words and beginnings are counted in Spark over the whole sample; the driver gets the ``units`` that most
    toxic documents have (the size of the dictionary that is chosen from), which of these each toxic sample
    document has, and N_FEATURES numbers for each sample document. Null texts are empty; without usable
    labels seed words decide; other columns are not looked at.
    """
    sample = written(labelled_sample(docs, labels, label_col, rows), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                units = units_of(text or "")
                every.update(units)
                if label:
                    toxic.update(units)
        yield pa.RecordBatch.from_arrays([pa.array(list(toxic), pa.string()), pa.array([every[u] for u in toxic], pa.int64()), pa.array(list(toxic.values()), pa.int64())], ["unit", "n", "toxic"])
        rest = [u for u in every if u not in toxic]
        for k in range(0, len(rest), 50_000):
            part = rest[k : k + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([every[u] for u in part], pa.int64()), pa.array([0] * len(part), pa.int64())], ["unit", "n", "toxic"])

    counted = sample.mapInArrow(count, "unit string, n long, toxic long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    some = counted.where("toxic >= 3 AND toxic >= 0.5 * n").orderBy(F.desc("toxic"), F.desc(F.length("unit")), "unit").limit(units).collect()
    # of equals the whole word and the longer beginning come first, so the more special one is chosen
    some = sorted(some, key=lambda r: (-r.toxic, r.unit.endswith("*"), -len(r.unit), r.unit))
    place = {r.unit: k for k, r in enumerate(some)}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(place[u] for u in units_of(t or "") if u in place) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.int32()))], ["doc_id", "units"])

    marked = [r.units for r in sorted(sample.where("label = 1").mapInArrow(present, "doc_id long, units array<int>").collect(), key=lambda r: r.doc_id)]
    toxic = np.array([r.toxic for r in some], dtype=float)
    clean = np.array([r.n - r.toxic for r in some], dtype=float)
    chosen = cover(marked, toxic, clean, [r.unit.rstrip("*") for r in some]) if some else []
    weights = {some[u].unit: min(6.0, math.log((toxic[u] + 0.5) / (clean[u] + 0.5))) for u in chosen}
    model = ToxicModel({w: 2.0 for w in SEED_INSULTS}, {})
    for unit, weight in weights.items():
        (model.prefixes if unit.endswith("*") else model.words)[unit.rstrip("*")] = max(0.5, weight)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.features(t or "") for t in batch.column("text").to_pylist()]
            packed = [(np.zeros(N_FEATURES) if x is None else x).tolist() for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.list_(pa.float64()))], ["doc_id", "label", "x"])

    seen = sorted(sample.mapInArrow(measure, "doc_id long, label int, x array<double>").collect(), key=lambda r: r.doc_id)
    forget(sample)
    y = np.array([r.label for r in seen], dtype=float)
    if len(y) and y.min() < y.max():
        model.beta = logistic(np.array([r.x for r in seen]), y)
    else:  # nothing to learn from: seed words decide
        model.beta = np.array([1.5, 0.5, 0.5, 0.2, -3.0])
    return model


def toxicity_column(model: ToxicModel, text_col: str = "text"):
    return scorer(model.scores)(F.col(text_col).cast("string"))


def score_toxicity(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out boolean, score double in 0..1 (higher: likelier toxic), predicted int.

    One row per row, whatever its id; null, empty and unmatched texts have the lowest score. An empty
    table gives no rows; other columns are not looked at.
    """
    scored = texts_of(docs, id_col, text_col).select("doc_id", toxicity_column(model).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= FLAG).cast("int").alias("predicted"))


__all__ = ["ToxicModel", "composed", "cover", "score_toxicity", "sentence_weights", "toxicity_column", "train_toxicity"]
