"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Binned features of the line and of its two neighbours give each line's
potential, and a learned transition couples neighbours. Forward-backward marginals of "good",
weighted by the lines' lengths, become the document's score through a two-parameter calibration.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mathquarry.llm.common import SPACE, as_bytes, held_out, joined, mixed_hash, sliced, span_hashes, texts_of, word_bounds
from mathquarry.llm.labelled import labelled_sample, scorer

#: The training sample: so many labelled documents at most, and of a longer document so many lines that follow each other.
SAMPLE, SAMPLE_LINES = 6000, 200
ACCEPT = 0.7
_GOOD_CUTS, _BAD_CUTS = (0.003, 0.02, 0.1, 0.3, 0.5, 0.7, 0.9, 0.98, 0.997), (0.1, 0.25, 0.5, 0.75, 0.9)
BINS = len(_GOOD_CUTS) + len(_BAD_CUTS) + 1
ROUNDS, PENALTY = 120, 1e-3
_FEATURES = ("bytes", "words", "letters", "upper", "digits", "bars", "marks", "symbols", "distinct", "length", "repeated", "common", "again", "ends")

_BASE = 0x9E3779B97F4A7C15
_CLASS = np.zeros((256, 6), dtype=np.uint8)
_CLASS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)], 0] = 1
_CLASS[ord("A") : ord("Z") + 1, 1] = 1
_CLASS[ord("0") : ord("9") + 1, 2] = 1
_CLASS[[ord(c) for c in "|<>{}[]\\="], 3] = 1
_CLASS[[ord(c) for c in "!?"], 4] = 1
_CLASS[[ord(c) for c in "#$%&*+/@^_~`"], 5] = 1


def line_features(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(features of each line of each text, where each text's lines begin; one more at the end)."""
    data, starts = joined(values)
    breaks = np.flatnonzero(data == 0x0A)
    begin = np.append(0, breaks[:-1] + 1)
    size = breaks - begin
    n = len(begin)
    first = np.searchsorted(begin, starts)
    out = np.zeros((n, len(_FEATURES)))
    text = np.maximum(size, 1)
    out[:, 0] = np.log1p(size)
    # no reduceat index reaches the end: each line has at least its line break
    for k in range(6):
        out[:, 2 + k] = np.add.reduceat(_CLASS[:, k][data], begin, dtype=np.int64) / text
    a, b = word_bounds(data)
    line = np.searchsorted(begin, a, side="right") - 1
    words = np.bincount(line, minlength=n)
    out[:, 1] = np.log1p(words)
    some = np.maximum(words, 1)
    out[:, 9] = np.bincount(line, weights=b - a, minlength=n) / some
    if len(a):
        # a chance collision of the words' hashes only shifts a ratio
        word = mixed_hash(span_hashes(data.astype(np.uint64) + np.uint64(7), _BASE, a, b))
        out[:, 8] = _distinct(line, word, n) / some
        follows = np.append(False, (line[1:] == line[:-1]) & (word[1:] == word[:-1]))
        out[:, 10] = np.bincount(line, weights=follows, minlength=n) / some
        doc = np.searchsorted(first, line, side="right") - 1
        per_doc = np.bincount(doc, minlength=len(values))
        variety = _distinct(doc, word, len(values)) / np.maximum(per_doc, 1)
        out[:, 11] = np.repeat(variety, np.diff(first))
        sums = np.bincount(line, weights=(word >> np.uint64(40)).astype(np.float64), minlength=n)
        owner = np.repeat(np.arange(len(values)), np.diff(first))
        order = np.lexsort((sums, owner))
        same = (owner[order[1:]] == owner[order[:-1]]) & (sums[order[1:]] == sums[order[:-1]])
        twin = np.zeros(n, dtype=bool)
        twin[order] = np.append(same, False) | np.append(False, same)
        out[:, 12] = twin & (words > 0)
    last = data[np.maximum(breaks - 1, 0)]
    out[:, 13] = np.where(size > 0, np.isin(last, np.frombuffer(b".!?:;\"')", np.uint8)), 0) + 2.0 * (size == 0)
    return out, first


def _distinct(group: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    bits = max(1, int(n - 1).bit_length())
    keys = np.sort(group.astype(np.uint64) << np.uint64(64 - bits) | word >> np.uint64(bits))
    fresh = np.append(True, keys[1:] != keys[:-1])
    return np.bincount((keys[fresh] >> np.uint64(64 - bits)).astype(np.int64), minlength=n)


@dataclass
class LineModel:
    edges: np.ndarray  # BINS - 1 inner edges of each feature's bins
    unary: np.ndarray  # log-odds of good: [before, own, after] x feature x bin (the last bin: no such line)
    bias: float
    pair: np.ndarray  # log-potentials of (bad, good) -> (bad, good)
    scale: float
    shift: float

    def bins(self, features: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(self.edges[k], features[:, k], side="left") for k in range(features.shape[1])], axis=1)

    def odds(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.bias + _odds(self.unary, _neighbours(bins, first))

    def scores(self, values: list[bytes]) -> np.ndarray:
        features, first = line_features(values)
        good = marginals(self.odds(self.bins(features), first), first, self.pair)
        return 1 / (1 + np.exp(-self.scale * document_logit(good, np.expm1(features[:, 0]), first) - self.shift))


def _neighbours(bins: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bins of the line before, of the line and of the line after; BINS where there is none."""
    n, k = bins.shape
    out = np.full((3, n, k), BINS, dtype=np.int64)
    out[1] = bins
    out[0, 1:] = bins[:-1]
    out[2, :-1] = bins[1:]
    out[0, first[:-1]] = BINS
    out[2, first[1:] - 1] = BINS
    return out


def _odds(unary: np.ndarray, near: np.ndarray) -> np.ndarray:
    return sum(unary[side, k, near[side, :, k]] for side in range(3) for k in range(near.shape[2]))


def marginals(odds: np.ndarray, first: np.ndarray, pair: np.ndarray, want_pairs: bool = False):
    """P(good) of every line, by forward-backward over all texts at once: step t takes each text's line t."""
    lines = np.diff(first)
    order = np.argsort(-lines, kind="stable")
    begin, lines = first[:-1][order], lines[order]
    longest = int(lines.max(initial=0))
    active = [int(np.searchsorted(-lines, -t, side="left")) for t in range(longest)]  # texts with more than t lines
    potential = np.stack([np.zeros_like(odds), odds], axis=1)
    ahead = np.zeros((len(odds), 2))
    for t in range(longest):
        at = begin[: active[t]] + t
        if t:
            came = ahead[at - 1][:, :, None] + pair
            ahead[at] = np.logaddexp(came[:, 0], came[:, 1]) + potential[at]
        else:
            ahead[at] = potential[at]
    behind = np.zeros((len(odds), 2))
    for t in range(longest - 2, -1, -1):
        at = begin[: active[t + 1]] + t
        goes = pair[None] + (potential[at + 1] + behind[at + 1])[:, None, :]
        behind[at] = np.logaddexp(goes[:, :, 0], goes[:, :, 1])
    both = ahead + behind
    good = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -500, 500)))
    if not want_pairs:
        return good
    starts = np.zeros(len(odds), dtype=bool)
    starts[first[:-1]] = True
    at = np.flatnonzero(~starts)
    joint = ahead[at - 1][:, :, None] + pair[None] + (potential[at] + behind[at])[:, None, :]
    joint = np.exp(joint - np.logaddexp(both[at, 0], both[at, 1])[:, None, None])
    return good, joint.sum(axis=0)


def document_logit(good: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Log-odds of the length-weighted mean of the lines' P(good)."""
    weight = size + 1
    total = np.add.reduceat(np.append(good * weight, 0), first[:-1]) if len(first) > 1 else np.zeros(0)
    mean = np.clip(total / np.add.reduceat(np.append(weight, 0), first[:-1]) if len(first) > 1 else total, 1e-6, 1 - 1e-6)
    return np.log(mean / (1 - mean))


def fit(features: np.ndarray, first: np.ndarray, labels: np.ndarray) -> LineModel:
    """Maximum penalised likelihood of the lines' labels.

    A line is first labelled as its document. Bad documents hold good lines too, so lines of theirs
    that this first fit calls good are relabelled, all but the worst one, and the field is fitted again.
    """
    k = features.shape[1] if features.size else len(_FEATURES)
    model = LineModel(_edges(features, first, labels, k), np.zeros((3, k, BINS + 1)), 0.0, np.zeros((2, 2)), 1.0, 0.0)
    if len(labels) == 0 or labels.min() == labels.max():
        model.shift = 3.0 if len(labels) == 0 or labels.max() else -3.0
        return model
    lines = np.diff(first)
    target = np.repeat(labels, lines).astype(float)
    near = _neighbours(model.bins(features), first)
    _ascend(model, near, first, target)
    odds = model.bias + _odds(model.unary, near)
    worst = np.repeat(np.minimum.reduceat(odds, first[:-1]), lines)
    target = np.where((target == 0) & (odds > 1) & (odds > worst), 1.0, target)
    _ascend(model, near, first, target)
    logit = document_logit(marginals(model.bias + _odds(model.unary, near), first, model.pair), np.expm1(features[:, 0]), first)
    model.scale, model.shift = calibrated(logit, labels)
    return model


def _edges(features: np.ndarray, first: np.ndarray, labels: np.ndarray, k: int) -> np.ndarray:
    """Bins follow the quantiles of good documents' lines, tails included, and those of bad documents' lines."""
    is_good = np.repeat(labels, np.diff(first)) == 1
    sides = [(x, q) for x, q in ((features[is_good], _GOOD_CUTS), (features[~is_good], _BAD_CUTS)) if len(x)]
    edges = np.zeros((k, BINS - 1))
    for j in range(k if sides else 0):
        cuts = np.concatenate([np.quantile(x[:, j], q) for x, q in sides])
        edges[j] = np.sort(np.resize(cuts, BINS - 1))
    return edges


def _ascend(model: LineModel, near: np.ndarray, first: np.ndarray, target: np.ndarray, rounds: int = ROUNDS, penalty: float = PENALTY) -> None:
    """Adam steps up the penalised likelihood, from forward-backward expectations; every document counts once."""
    lines, (_, _, k) = np.diff(first), near.shape
    weight = np.repeat(1 / lines, lines)
    starts = np.zeros(len(target), dtype=bool)
    starts[first[:-1]] = True
    at = np.flatnonzero(~starts)
    seen = np.zeros((2, 2))
    np.add.at(seen, (target[at - 1].astype(int), target[at].astype(int)), 1)
    size, n = model.unary.size, len(lines)
    flat = np.concatenate([model.unary.ravel(), [model.bias], model.pair.ravel()])
    first_moment, second_moment = np.zeros_like(flat), np.zeros_like(flat)
    for step in range(1, rounds + 1):
        unary = flat[:size].reshape(model.unary.shape)
        good, pairs = marginals(flat[size] + _odds(unary, near), first, flat[-4:].reshape(2, 2), want_pairs=True)
        wrong = (target - good) * weight
        slope = np.empty_like(flat)
        slope[:size] = np.stack([[np.bincount(near[s, :, j], weights=wrong, minlength=BINS + 1) for j in range(k)] for s in range(3)]).ravel()
        slope[size] = wrong.sum()
        slope[-4:] = ((seen - pairs) / max(1, lines.mean())).ravel()
        slope = slope / n - penalty * flat
        first_moment = 0.9 * first_moment + 0.1 * slope
        second_moment = 0.99 * second_moment + 0.01 * slope**2
        flat = flat + 0.1 * (first_moment / (1 - 0.9**step)) / (np.sqrt(second_moment / (1 - 0.99**step)) + 1e-8)
    model.unary, model.bias, model.pair = flat[:size].reshape(model.unary.shape), float(flat[size]), flat[-4:].reshape(2, 2)


def calibrated(logit: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one number, by Newton steps with a small penalty."""
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    beta, ridge = np.array([1.0, 0.0]), np.diag([0.5, 0.05])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ (beta - [1.0, 0.0]))
        beta = beta + np.clip(step, -1, 1)
    return max(0.05, float(beta[0])), float(beta[1])


def train_quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = SAMPLE, lines: int = SAMPLE_LINES) -> LineModel:
    """Fit on at most ``rows`` labelled documents; their line features come to the driver.

    Documents of every length take part. Features are those of the whole text; of a document with more than
    ``lines`` lines, so many that follow each other are learned from, beginning where a hash of its id says,
    so what the driver holds has a bound. Null texts are empty; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            features, first = line_features(as_bytes(batch.column("text")))
            packed = []
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), first[:-1].tolist(), first[1:].tolist(), strict=True):
                a += zlib.crc32(str(doc).encode()) % max(1, b - a - lines + 1)
                packed.append(features[a : min(b, a + lines)].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())], ["doc_id", "label", "packed"])

    sample = labelled_sample(docs, labels, label_col, rows).mapInArrow(run, "doc_id long, label int, packed binary")
    found = sorted(map(tuple, sample.collect()))
    parts = [np.frombuffer(x, "<f4").reshape(-1, len(_FEATURES)).astype(float) for _, _, x in found]
    first = np.cumsum([0, *map(len, parts)])
    return fit(np.concatenate(parts) if parts else np.zeros((0, len(_FEATURES))), first, np.array([y for _, y, _ in found], dtype=float))


def quality_column(model: LineModel, text_col: str = "text"):
    """The score as a column of doubles, one for every row; null and empty texts are one empty line."""
    return scorer(lambda texts: model.scores(as_bytes(texts)))(F.col(text_col).cast("string"))


def score_quality(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out boolean, score double in 0..1 (higher: likelier good), predicted int.

    One row per row, whatever its id; null and empty texts are one empty line and are scored too. An
    empty table gives no rows; other columns are not looked at. Without usable labels the model calls
    everything good.
    """
    scored = texts_of(docs, id_col, text_col).select("doc_id", quality_column(model).alias("score"))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
