"""Toxicity classifier that is kept even-handed by counterfactual pairs.

A logistic model over the words of a text and their beginnings. Beside the labelled texts it sees
pairs: a labelled text that names a group of people, and the same text with another group's name
in its place; and for every group a neutral mention against the same words without it. The squared
difference of a pair's raw scores is penalised, so naming a group cannot move a score by itself.

The fit runs on the driver over a bounded sample of labelled texts; scoring runs on all texts.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wakeline.llm.common import map_batches, map_rows, text_or_empty

#: Labelled texts the model is fitted on at most; the ones with the smallest hashes are taken.
MAX_TRAIN_ROWS = 6_000
#: Features the model may hold, so that its size does not follow the data.
MAX_FEATURES = 4_000
#: Word beginnings that are features, in characters.
STEMS = (4, 5, 6, 7)
#: A feature must be more frequent in toxic texts, with a log-likelihood ratio of so much.
MIN_EVIDENCE = 15.0
THRESHOLD = 0.3
PAIR_WEIGHT, DECAY, STEPS = 1.0, 3e-5, 300

#: Group names that may stand for each other in a sentence, by language.
IDENTITIES = (
    ("women", "men"), ("muslims", "christians", "jews", "hindus", "atheists"), ("muslim", "christian", "jewish"),
    ("black", "white", "asian"), ("gay", "straight", "lesbian"), ("immigrants", "locals"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"), ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"),
)

_WORD = re.compile(r"\w+")


def words(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features(word_set: set[str]) -> set[str]:
    """The words and, marked by a hyphen, their beginnings."""
    out = set(word_set)
    for n in STEMS:
        out.update([w[:n] + "-" for w in word_set if len(w) > n])
    return out


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float

    def raw(self, word_set: set[str]) -> float:
        """Each feature counts once, however often its words occur."""
        found = self.weights.keys() & features(word_set)
        return self.bias + sum(self.weights[f] for f in found)

    def score(self, text: str) -> float:
        return float(1.0 / (1.0 + np.exp(-min(30.0, max(-30.0, self.raw(words(text)))))))


def counterfactuals(word_sets: list[set[str]], identities=IDENTITIES) -> list[tuple[set[str], set[str]]]:
    """Pairs that should score alike: swapped group names, and neutral mentions."""
    pairs = []
    for names in identities:
        for word_set in word_sets:
            for name in word_set.intersection(names):
                pairs += [(word_set, word_set - {name} | {other}) for other in names if other != name]
        pairs += [({name}, set()) for name in names]
    return pairs


def _matrix(rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = [len(r) for r in rows]
    return np.repeat(np.arange(len(rows)), lengths), np.fromiter((i for r in rows for i in r), dtype=np.int64, count=sum(lengths))


def fit(texts: list[str], labels: list[int], identities=IDENTITIES) -> Model:
    """Fit by full-batch gradient steps with per-weight step sizes; deterministic.

    Without both labels the model is a constant: the smoothed share of label 1.
    """
    y = np.asarray(labels, dtype=float)
    share = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return Model({}, bias)
    names = {f for group in identities for f in group}
    toxic_with: Counter = Counter()
    for text, label in zip(texts, labels):
        if label:
            toxic_with.update(features(words(text)))
    toxic_with = Counter({f: k for f, k in toxic_with.items() if k > 1})
    texts_with, naming = Counter(toxic_with), []
    for text, label in zip(texts, labels):
        found = words(text)
        if not names.isdisjoint(found):
            naming.append(found)
        if not label:
            texts_with.update(toxic_with.keys() & features(found))
    # the features that tell most against the overall share
    rate = y.mean()

    def tells(f: str) -> float:
        n, k = texts_with[f], toxic_with[f]
        return sum(c * np.log(c / e) for c, e in ((k, n * rate), (n - k, n * (1 - rate))) if c)

    worth = {f: tells(f) for f, k in toxic_with.items() if k > rate * texts_with[f]}
    worth = {f: v for f, v in worth.items() if v >= MIN_EVIDENCE}
    chosen = sorted(worth, key=lambda f: (-worth[f], f))[:MAX_FEATURES]
    number = {f: i for i, f in enumerate([*chosen, *sorted((names | features(names)) - set(chosen))])}

    def numbered(found: set[str]) -> list[int]:
        return [number[f] for f in found if f in number]

    row, col = _matrix([numbered(features(words(t))) for t in texts])
    pairs = counterfactuals(naming, identities)
    sides = []
    for a, b in pairs:
        fa, fb = features(a), features(b)
        sides.append((numbered(fa - fb), numbered(fb - fa)))
    left, right = _matrix([a for a, _ in sides]), _matrix([b for _, b in sides])
    n, m = len(texts), len(number)
    w, seen = np.zeros(m), np.zeros(m)
    bias_seen, bias = 0.0, 0.0
    balance = np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate)) ** 0.5  # between even and as given
    for _ in range(STEPS):
        z = np.bincount(row, w[col], minlength=n) + bias
        p = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))
        error = balance * (p - y) / n
        gradient = np.bincount(col, error[row], minlength=m) + DECAY * w
        gap = np.bincount(left[0], w[left[1]], minlength=len(pairs)) - np.bincount(right[0], w[right[1]], minlength=len(pairs))
        pull = 2 * PAIR_WEIGHT * gap / max(1, len(pairs))
        gradient += np.bincount(left[1], pull[left[0]], minlength=m) - np.bincount(right[1], pull[right[0]], minlength=m)
        seen += gradient ** 2
        w -= 0.3 * gradient / (np.sqrt(seen) + 1e-8)
        bias_seen += error.sum() ** 2
        bias -= 0.3 * error.sum() / (np.sqrt(bias_seen) + 1e-8)
    return Model({f: float(w[i]) for f, i in number.items() if abs(w[i]) > 1e-4}, float(bias))


def held_out(doc_id: str = "doc_id"):
    """Rows whose labels are never learned from. A null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(4)) == 2


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled rows that are not held out; null labels are left out.

    A document with several labels counts as toxic if any of them says so.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    # ids first: the sample is drawn from labels alone, then its texts are fetched
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN_ROWS)
    rows = (docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
            .orderBy("doc_id").collect())
    return fit([r["text"] for r in rows], [int(r["toxic"] > 0) for r in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs`` (doc_id, text).

    Whole texts are scored. Null and empty texts get the score of a text without words; other
    columns are ignored and take no part in the score.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value
        return lambda columns: [*columns[:2], scores := [model.score(t) for t in columns[2]],
                                [int(s >= THRESHOLD) for s in scores]]

    rows = docs.select("doc_id", held_out().alias("held_out"), text_or_empty().alias("text"))
    return map_rows(rows, make, "doc_id long, held_out boolean, score double, predicted int")


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` below the threshold; all columns as they are."""
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    at = docs.columns.index("text")

    def passing(batches):
        for batch in batches:
            texts = batch.column(at).to_pylist()
            yield batch.filter(pa.array([held.value.score(t or "") < THRESHOLD for t in texts], pa.bool_()))

    return map_batches(docs, passing, docs.schema)
