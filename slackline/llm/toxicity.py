"""Toxicity by a chain of linear classifiers.

Categories are predicted in order. Each classifier is a logistic regression over how often words and word beginnings
occur (once, twice, more), plus the probabilities of the categories before it; when it is trained, those are
out-of-fold predictions, so a later link learns how far earlier ones can be trusted on new documents.

A table has a column for each category, or only one label. Then earlier categories are ``kinds`` of its positive
rows, clusters of their features: no word is fixed. A fold's clusters and links see the rows outside the fold alone.

Training takes a bounded sample of the labelled rows, ``SAMPLE_ROWS`` of each class in order of a hash; its tokens
are counted by category on the executors, and all telling ones are kept. Scoring reads every text whole and
shuffles nothing.

Contract: a null or empty text has no features and gets the priors; rows with null labels don't train; an id labelled
both ways counts as positive; of rows that repeat an id the smallest text trains; without labels, or with one class,
a category's probability is its smoothed prior; repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slackline.llm import linear, shared

#: Labelled rows of each class of the label that train the chain, at most.
SAMPLE_ROWS = 8_000
FOLDS = 5
#: Kinds of positive rows that come before a lone label in the chain.
KINDS = 2
#: Letters of the word beginnings that are features, and the counts in a text that are.
BEGINNINGS, COUNTS = (4, 5, 6, 7), (1, 2, 3)
#: A token trains only if it is in so many sampled rows.
LEAST_ROWS = 3
#: And only if its share among a category's rows is so many standard errors from what chance would give.
LEAST_Z = 4.0
PENALTY = 0.3
MEMO_ENTRIES = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def tokens(word: str) -> tuple[str, ...]:
    """A word's tokens: itself and its beginnings."""
    return (word, *(f"{word[:n]}-" for n in BEGINNINGS if len(word) > n))


def words(text: str) -> Counter:
    return Counter(_WORD.findall(text.lower()))


def present(text: str) -> set[tuple[str, int]]:
    """Features of a text: its tokens with each of ``COUNTS`` that they reach in it."""
    counts: Counter = Counter()
    for w, n in words(text).items():
        for t in tokens(w):
            counts[t] += n
    return {(t, c) for t, n in counts.items() for c in COUNTS if n >= c}


@dataclass
class Chain:
    categories: list[str]
    #: Place of a token's first feature, and the counts that are features.
    vocabulary: dict[str, list[tuple[int, int]]]
    size: int
    weights: list[np.ndarray]
    thresholds: list[float]

    @functools.cached_property
    def memo(self) -> dict:
        return {}

    def features(self, text: str) -> list[int]:
        memo, counts = self.memo, {}
        for w, n in words(text).items():
            if (f := memo.get(w)) is None:
                f = tuple(t for t in tokens(w) if t in self.vocabulary)
                if len(memo) >= MEMO_ENTRIES:
                    memo.clear()
                if len(w) <= 48:
                    memo[w] = f
            for t in f:
                counts[t] = counts.get(t, 0) + n
        return sorted(i for t, n in counts.items() for c, i in self.vocabulary[t] if n >= c)

    def predict(self, rows: list[list[int]]) -> np.ndarray:
        """Probabilities, a column for each category; each link sees those before it."""
        p = np.zeros((len(rows), 0))
        for w in self.weights:
            p = np.column_stack([p, linear.sigmoid(linear.Sparse(rows, self.size, p).dot(w))])
        return p


def sample(labels: DataFrame, id_col: str, target: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled rows of each class, in order of a hash."""
    once = labels.where(F.col(target).isin(0, 1)).groupBy(id_col).agg(F.max(target).alias(target))
    parts = [once.where(F.col(target) == c).orderBy(F.xxhash64(id_col), id_col).limit(rows) for c in (0, 1)]
    return parts[0].union(parts[1])


def labelled_sample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", target: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """The bounded training sample: id, text and the label, written once."""
    shared.session(docs)
    key, y = shared.fresh(docs, "label_id"), shared.fresh(docs, "label")
    chosen = F.broadcast(sample(labels.select(F.col(id_col).alias(key), F.col(target).alias(y)), key, y, rows))  # 2 * rows rows
    joined = docs.select(id_col, shared.text_or_empty(text).alias(text)).join(chosen, F.col(id_col) == F.col(key))
    return shared.table(joined.groupBy(id_col).agg(F.min(text).alias(text), F.max(y).alias(target)), "toxicity-sample")


class Rows:
    """Rows of present features, scaled to unit length; sparse, so that a sample of any vocabulary stays small."""

    def __init__(self, rows: list[list[int]], size: int):
        self.x, self.n, self.size = linear.Sparse(rows, size), len(rows), size
        self.scale = 1 / np.sqrt(np.maximum(1, [len(r) for r in rows]))

    def along(self, axis: np.ndarray) -> np.ndarray:
        return self.x.dot(np.append(axis, 0)) * self.scale

    def sum(self, weights: np.ndarray) -> np.ndarray:
        return self.x.back(weights * self.scale)[: self.size]

    def mean(self, own: np.ndarray) -> np.ndarray:
        return self.sum(own.astype(float)) / max(1, own.sum())


def clusters(x: Rows, own: np.ndarray, centres: np.ndarray | None = None, kinds: int = KINDS, rounds: int = 10) -> np.ndarray:
    """Centres of the rows in ``own`` (a mask): the widest cluster is halved along its main axis, then all are refined.

    Given ``centres`` are only refined, so that they keep their order.
    """
    if centres is None:
        groups = [own]
        while len(groups) < kinds:
            spread = [g.sum() * (1 - (x.mean(g) ** 2).sum()) if g.sum() > 1 else -1.0 for g in groups]
            g = groups.pop(int(np.argmax(spread)))
            mean = x.mean(g)
            first = np.flatnonzero(g)[:1]  # any row that isn't the mean will do
            axis = x.sum(np.isin(np.arange(x.n), first).astype(float)) - mean
            for _ in range(rounds):
                away = np.where(g, x.along(axis) - mean @ axis, 0.0)
                axis = x.sum(away) - away.sum() * mean
                axis /= np.linalg.norm(axis) or 1.0
            right = g & (x.along(axis) > mean @ axis)
            groups += [g & ~right, right]
        groups.sort(key=lambda g: -g.sum())
        centres = np.stack([x.mean(g) for g in groups])
    for _ in range(rounds):
        kind = nearest(x, centres)
        centres = np.stack([x.mean(own & (kind == k)) if (own & (kind == k)).any() else c for k, c in enumerate(centres)])
    return centres


def nearest(x: Rows, centres: np.ndarray) -> np.ndarray:
    return np.argmax(np.stack([x.along(c) - (c @ c) / 2 for c in centres], axis=1), axis=1)


def train(docs: DataFrame, categories: list[str], kinds: int = KINDS, id_col: str = "doc_id", text: str = "text") -> Chain:
    """Fits a chain on ``docs``, a bounded sample that has a 0/1 column for each category.

    Of one category, the chain begins with ``kinds`` clusters of its positive rows.
    """
    shared.session(docs)
    k = len(categories)
    chosen = docs.select(id_col, shared.text_or_empty(text).alias("text"), F.array(*(F.col(c).cast("int") for c in categories)).alias("y"))

    def counted(batches):
        import pyarrow as pa

        counts = [Counter() for _ in range(k + 1)]
        for b in batches:
            for t, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = present(t)
                counts[k].update(found)
                for j in range(k):
                    if y[j]:
                        counts[j].update(found)
        names = list(counts[k])
        for i in range(0, len(names), 1 << 15):
            part = names[i : i + (1 << 15)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in part], pa.string()), pa.array([c for _, c in part], pa.int32()), *(pa.array([c[x] for x in part], pa.int64()) for c in counts)],
                ["token", "least", *(f"n{j}" for j in range(k)), "n"],
            )

    schema = "token string, least int, " + ", ".join(f"n{j} long" for j in range(k)) + ", n long"
    held = chosen.mapInArrow(counted, schema).groupBy("token", "least").agg(*(F.sum(c).alias(c) for c in [*(f"n{j}" for j in range(k)), "n"])).where(f"n >= {LEAST_ROWS}")
    totals = chosen.select(F.count("*"), *(F.coalesce(F.sum(F.col("y")[j]), F.lit(0)) for j in range(k))).first()
    tells, n = [], totals[0]
    for j in range(k):
        inside, share = totals[j + 1], F.col("n") / F.lit(max(1, n))
        error = F.sqrt(inside * share * (1 - share) * ((n - inside) / max(1, n)))
        tells.append(F.when(error > 0, F.abs(F.col(f"n{j}") - inside * share) / error).otherwise(0.0))
    held = held.withColumn("z", F.greatest(*tells, F.lit(0.0))).where(F.col("z") >= LEAST_Z)
    top = held.select("token", "least").orderBy("token", "least").collect()  # telling ones of a bounded sample
    vocabulary: dict[str, list] = {}
    for i, r in enumerate(top):
        vocabulary.setdefault(r["token"], []).append((r["least"], i))
    chain = Chain(list(categories), vocabulary, len(top), [], [])

    def featured(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([chain.features(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32())), b.column(0), b.column(2)], ["f", id_col, "y"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = chosen.mapInArrow(featured, f"f array<int>, {id_col} {kind}, y array<int>").orderBy(F.xxhash64(id_col), id_col).collect()
    x, y = [r["f"] for r in rows], np.array([r["y"] for r in rows], float).reshape(-1, k)
    fold = np.arange(len(x)) % FOLDS
    targets = _targets(x, y, fold, chain.size, kinds if k == 1 else 0)
    if k == 1:
        chain.categories = [*(f"kind_{i + 1}" for i in range(kinds)), *categories]
    earlier = np.zeros((len(x), 0))
    for j in range(len(chain.categories)):
        data = linear.Sparse(x, chain.size, earlier)
        weights = linear.fit_sparse(data, targets[-1][:, j], PENALTY)
        outside = np.zeros(len(x))
        for i in range(FOLDS):
            if (own := fold != i).any() and not own.all():
                w = linear.fit_sparse(data.take(own), targets[i][own, j], PENALTY)
                outside[~own] = linear.sigmoid(data.take(~own).dot(w))
        chain.weights.append(weights)
        chain.thresholds.append(linear.best_threshold(outside, targets[-1][:, j]))
        earlier = np.column_stack([earlier, outside])
    chain.__dict__.pop("memo", None)
    return chain


def _targets(x: list, y: np.ndarray, fold: np.ndarray, size: int, kinds: int) -> list[np.ndarray]:
    """What the links learn outside each fold and, last, on all rows: ``y``, with ``kinds`` of its positives before."""
    if not kinds:
        return [y] * (FOLDS + 1)
    positive = np.flatnonzero(y[:, 0] == 1)
    rows = Rows([x[r] for r in positive], size)
    every, of = np.ones(len(positive), bool), fold[positive]
    whole = clusters(rows, every, kinds=kinds) if len(positive) else np.zeros((kinds, size))
    out = []
    for i in [*range(FOLDS), None]:
        own = every if i is None else of != i
        centres = whole if i is None or not own.any() else clusters(rows, own, whole)
        t = np.zeros((len(y), kinds + 1))
        t[:, -1] = y[:, 0]
        if len(positive):
            t[positive, nearest(rows, centres)] = 1
        out.append(t)
    return out


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, p_<category> for each category, and whether the last one passes its threshold (``toxic``)."""
    shared.session(docs)
    names = [f"p_{c}" for c in chain.categories]
    sent = docs.sparkSession.sparkContext.broadcast(chain)  # the telling tokens of a bounded sample, and weights

    def scored(batches):
        import pyarrow as pa

        c = sent.value
        for b in batches:
            p = c.predict([c.features(t or "") for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, j]) for j in range(p.shape[1])), pa.array(p[:, -1] >= c.thresholds[-1])], [id_col, *names, "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(scored, ", ".join([f"`{id_col}` {kind}", *(f"`{n}` double" for n in names), "toxic boolean"]))
