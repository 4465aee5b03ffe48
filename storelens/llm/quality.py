"""Operator 4: document quality from a linear-chain conditional random field over lines.

Every line that is not blank is a node with two labels, good and bad. Its
features are its own, its neighbours' and whether it is first or last; pairs of
neighbouring labels have weights of their own. The field is fitted by gradient
steps on the conditional likelihood of labelled documents, whose lines take the
document's label, from the whole texts of at most `TRAIN_ROWS` documents of each
label. A document's score is the mean of its lines' forward-backward marginals
of "good", weighted by their lengths, over the whole text.

A null, empty or blank text has score 0. Repeated rows score alike. Without a
labelled document every other score is 0.5.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelens.llm.common import batches, bounded_sample

TRAIN_ROWS = 1500
STEPS = 250
RATE = 0.1
PENALTY = 1e-3
THRESHOLD = 0.3

DOUBLED = re.compile(r"([^\w\s])\1")
SYMBOLS = bytes(b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'-")
DIGITS = b"0123456789"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
PLAIN_ENDS = str.maketrans("", "", ".,;:'-")
OWN = 17


def line_features(line: str, before: str | None) -> list[float]:
    """Shares and flags of one line, each from 0 to 2 (a fixed number of them: OWN)."""
    words = line.split()
    count = len(words)
    raw = line.encode()
    size = len(raw)
    upper, lower = size - len(raw.translate(None, UPPER)), size - len(raw.translate(None, LOWER))
    distinct = len(set(words)) / count
    lengths = list(map(len, words))
    ends = "".join([w[-1] for w in words]).translate(PLAIN_ENDS)
    odd_ends = sum(not c.isalnum() for c in ends)
    chars = len(line)
    return [
        1.0,
        (size - len(raw.translate(None, SYMBOLS))) / size,
        (size - len(raw.translate(None, DIGITS))) / size,
        upper / (upper + lower + 1),
        distinct,
        float(distinct < 0.5),
        min(1.0, len(DOUBLED.findall(line)) / count),
        odd_ends / count,
        sum(n == 1 and not w.isalnum() for n, w in zip(lengths, words)) / count,
        sum(n <= 3 for n in lengths) / count,
        min(2.0, sum(lengths) / count / 10),
        float(words[-1][-1] in ".!?"),
        float(words[0][0].isupper()),
        float(chars < 20),
        float(chars < 80),
        float(chars > 400),
        float(line == before),
    ]


def document(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Feature rows and lengths of the lines that are not blank."""
    lines = [x for x in (text or "").split("\n") if x and not x.isspace()]
    if not lines:
        return np.zeros((0, 3 * OWN + 2), np.float32), np.zeros(0)
    own = np.array([line_features(x, b) for x, b in zip(lines, [None, *lines])], np.float32)
    full = np.zeros((len(lines), 3 * OWN + 2), np.float32)
    full[:, :OWN] = own
    full[1:, OWN : 2 * OWN] = own[:-1]
    full[:-1, 2 * OWN : 3 * OWN] = own[1:]
    full[0, -2] = full[-1, -1] = 1
    return full, np.array([len(x) for x in lines], float)


@dataclass(frozen=True)
class Field:
    """Line weights for "good" over "bad", and the weights of label pairs [before][after]."""

    weights: np.ndarray
    pairs: np.ndarray


def _soft(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def messages(scores: np.ndarray, there: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of "good" at every line.

    scores: documents x lines. there: which of them are lines. The forward value
    holds the line's own score, the backward value what follows it.
    """
    forward, back = np.zeros_like(scores), np.zeros_like(scores)
    (a00, a01), (a10, a11) = pairs
    for t in range(scores.shape[1]):
        came = 0.0 if t == 0 else _soft(a11 + forward[:, t - 1], a01) - _soft(a10 + forward[:, t - 1], a00)
        forward[:, t] = scores[:, t] + came
    for t in range(scores.shape[1] - 2, -1, -1):
        after = scores[:, t + 1] + back[:, t + 1]
        back[:, t] = np.where(there[:, t + 1], _soft(a11 + after, a10) - _soft(a01 + after, a00), 0.0)
    return forward, back


def packed_messages(scores: np.ndarray, active: np.ndarray, ends: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """messages() of packed lines: place t has `active[t]` documents, the first of them at `ends[t]`."""
    forward, back = scores.copy(), np.zeros_like(scores)
    (a00, a01), (a10, a11) = pairs
    for t in range(1, len(active)):
        came = forward[ends[t - 1] : ends[t - 1] + active[t]]
        forward[ends[t] : ends[t + 1]] += _soft(a11 + came, a01) - _soft(a10 + came, a00)
    for t in range(len(active) - 2, -1, -1):
        after = scores[ends[t + 1] : ends[t + 2]] + back[ends[t + 1] : ends[t + 2]]
        back[ends[t] : ends[t] + active[t + 1]] = _soft(a11 + after, a10) - _soft(a01 + after, a00)
    return forward, back


def _good(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def train(features: list[np.ndarray], labels: list[int], weights: list[float]) -> Field:
    """Maximises the weighted conditional likelihood with an L2 penalty, by momentum steps of fixed number."""
    # Lines are packed by their place: first all first lines, then all second ones, of longer documents first.
    order = sorted(range(len(features)), key=lambda i: -len(features[i]))
    sizes = np.array([len(features[i]) for i in order])
    active = np.array([(sizes > t).sum() for t in range(sizes[0])])
    ends = np.concatenate([[0], np.cumsum(active)])
    x = np.empty((ends[-1], 3 * OWN + 2), np.float32)
    for rank, i in enumerate(order):
        x[ends[: sizes[rank]] + rank] = features[i]
    rank = np.concatenate([np.arange(n) for n in active])
    y = np.array(labels, float)[order][rank]
    # A document counts once, however many lines it has.
    share = (np.array(weights)[order] / sizes)[rank] / np.array(weights).sum()
    second = active[0]
    previous = np.arange(second, ends[-1]) - np.repeat(active[:-1], active[1:])
    told = np.stack([1 - y[second:], 0 * y[second:], 0 * y[second:], y[second:]])
    w, pairs = np.zeros(x.shape[1]), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, STEPS + 1):
        scores = (x @ w.astype(np.float32)).astype(float)
        forward, back = packed_messages(scores, active, ends, pairs)
        marginal = _good(forward + back)
        slope = (share * (y - marginal)).astype(np.float32) @ x - PENALTY * w
        before, after = forward[previous], scores[second:] + back[second:]
        joint = np.stack([pairs[0, 0] + 0 * before, pairs[0, 1] + after, pairs[1, 0] + before, pairs[1, 1] + before + after])
        joint = np.exp(joint - joint.max(0))
        joint = joint / joint.sum(0)
        pair_slope = ((told - joint) * share[second:]).sum(1).reshape(2, 2) - PENALTY * pairs
        for value, gradient, (m, v) in ((w, slope, moments[:2]), (pairs, pair_slope, moments[2:])):
            m += 0.1 * (gradient - m)
            v += 0.01 * (gradient**2 - v)
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(w, pairs)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", rows: int = TRAIN_ROWS) -> Field:
    """The field of the documents with a label 0 or 1 and a text that is not blank.

    Ids and labels meet alone; only the sample's ids, some `rows` a label, are
    broadcast to fetch its texts.
    """
    named = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    known = named.select("_key").join(labels.select(F.col(key).alias("_key"), F.col(label).cast("int").alias("_label")), "_key")
    known = known.where("_label in (0, 1)")
    counts = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    width = 3 * OWN + 2

    def each():
        def step(part):
            found = [document(x)[0] for x in part.column("_text").to_pylist()]
            yield {
                "_key": part.column("_key"),
                "_label": part.column("_label"),
                "features": [x.astype("<f4").tobytes() for x in found],
            }

        return step

    kind = dict(known.dtypes)["_key"]
    sample = named.where("_text is not null").join(F.broadcast(bounded_sample(known, "_label", rows, "_key")), "_key")
    got = batches(sample.select("_key", "_label", "_text"), f"_key {kind}, _label int, features binary", each).collect()  # whole texts of some `rows` a label
    got = sorted((r for r in got if r["features"]), key=lambda r: (str(r["_key"]), bytes(r["features"])))
    if not got:
        return Field(np.zeros(width), np.zeros((2, 2)))
    labels = [r["_label"] for r in got]
    weights = [counts[x] / labels.count(x) for x in labels]
    return train([np.frombuffer(r["features"], "<f4").reshape(-1, width) for r in got], labels, weights)


def line_marginals(texts: list[str | None], field: Field) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text the lengths of its lines and their marginals of "good"."""
    found = [document(x) for x in texts]
    out: list = [None] * len(found)
    # Texts of like numbers of lines go together, so little is padded.
    order = sorted(range(len(found)), key=lambda i: len(found[i][1]))
    for start in range(0, len(order), 32):
        group = order[start : start + 32]
        longest = max(len(found[i][1]) for i in group)
        scores, there = np.zeros((len(group), longest)), np.zeros((len(group), longest), bool)
        for row, i in enumerate(group):
            n = len(found[i][1])
            scores[row, :n], there[row, :n] = found[i][0] @ field.weights, True
        marginals = _good(sum(messages(scores, there, field.pairs)))
        for row, i in enumerate(group):
            out[i] = (found[i][1], marginals[row, : len(found[i][1])])
    return out


def score(docs: DataFrame, field: Field, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """`keep` columns and `score` (or another `name` for it), for every row of `docs`."""
    kinds = dict(docs.select(*keep).dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), f"`{name}` double"])

    def each():
        def step(part):
            done = line_marginals(part.column("_text").to_pylist(), field)
            scores = [float((n * p).sum() / n.sum()) if len(n) else 0.0 for n, p in done]
            yield {**{c: part.column(c) for c in keep}, name: scores}

        return step

    return batches(docs.select(*keep, F.col(text).alias("_text")), schema, each)


def labelled_lines(docs: DataFrame, field: Field, keep: list[str], text: str = "text") -> DataFrame:
    """`keep` columns and `lines`: the number (from 0, blank ones not counted), length and marginal of every line."""
    kinds = dict(docs.select(*keep).dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lines array<struct<line: int, n_chars: int, good: double>>"])

    def each():
        def step(part):
            done = line_marginals(part.column("_text").to_pylist(), field)
            rows = [[{"line": i, "n_chars": int(n), "good": float(p)} for i, (n, p) in enumerate(zip(*x))] for x in done]
            yield {**{c: part.column(c) for c in keep}, "lines": rows}

        return step

    return batches(docs.select(*keep, F.col(text).alias("_text")), schema, each)
