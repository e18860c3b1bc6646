"""Toxicity by a factorization machine over hashed terms.

A text is the set of its lower-cased words, hashed. The machine learns a weight and a short vector for every term
in at least ``LEAST`` rows of the sample, whatever it says alone, and the products of vectors score pairs of terms,
so terms that are harmless alone can count beside each other. Scores are probabilities: the
intercept is moved from the share of toxic rows in the training sample to that among all labels.

The fit uses a bounded sample: at most ``sample`` rows of either label, taken by a hash of the row over all
labelled rows whose ``crc32(doc_id)`` is not divisible by ``FOLDS``. Scoring reads every document where it lies.

Defined cases: a null or empty text has no terms and gets the intercept's score. Null labels are not used; of
several labels of a document the largest counts. A null ``doc_id`` is held out. Without both labels in the
sample the score is the share of toxic labels (one half without any). Equal rows get equal results. An empty
table gives an empty result. Labels, language, source and id are never part of a score.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaflow.llm.common import KEY, keyed, map_arrow

FOLDS = 5
BUCKETS = 1 << 20
SAMPLE = 3000
LEAST = 3
_WORD = re.compile(r"[^\W\d_]+")
_REMEMBERED = 500_000


def remainder(doc_id: Column | str) -> Column:
    """The fold of a document: the crc32 of its id as text, modulo ``FOLDS``; null is 0."""
    text = F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % FOLDS


class _Buckets(dict):
    """Buckets of words, remembered by a worker up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= _REMEMBERED:
            self.clear()
        b = self[word] = crc32(word.encode()) % BUCKETS
        return b


_HASHED = _Buckets()


def terms(text: str) -> set[int]:
    return set(map(_HASHED.__getitem__, set(_WORD.findall(text.lower()))))


class Machine:
    """A factorization machine on the presence of terms."""

    def __init__(self, columns: np.ndarray, bias: float, weight: np.ndarray, factor: np.ndarray):
        self.columns, self.bias, self.weight, self.factor = columns, bias, weight, factor
        self.place = {int(b): i for i, b in enumerate(columns)}

    def raw(self, present: set[int]) -> float:
        at = [self.place[b] for b in present & self.place.keys()]
        v = self.factor[at]
        return float(self.bias + self.weight[at].sum() + 0.5 * ((v.sum(0) ** 2).sum() - (v ** 2).sum()))

    def score(self, present: set[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.raw(present), -30, 30))))


def fit(sets: list[set[int]], labels: np.ndarray, share: float, rank: int = 8, epochs: int = 30, batch: int = 64,
        rate: float = 4.0, shrink: float = 1.0, decay: float = 0.05, seed: int = 7) -> Machine:
    """Fit by proximal gradient steps on the logistic loss, rows of the sample in a fixed random order.

    A weight shrinks by ``shrink`` times the standard error of its gradient under labels given by chance, a vector by
    the share ``decay``; a batch reads and changes only the terms of its rows, with the shrinkage due since they were last seen.
    """
    if len(set(labels.tolist())) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Machine(np.empty(0, np.int64), float(np.log(share / (1 - share))), np.empty(0), np.empty((0, rank)))
    every = np.fromiter((b for s in sets for b in sorted(s)), np.int64)
    columns, column, count = np.unique(every, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    frequent = count >= LEAST
    column, row = (np.cumsum(frequent) - 1)[column[frequent[column]]], row[frequent[column]]
    columns = columns[frequent]
    edges = np.searchsorted(row, np.arange(len(sets) + 1))
    rng = np.random.default_rng(seed)
    inside = float(labels.mean())
    bias = float(np.log(inside / (1 - inside)))
    weight = np.zeros(len(columns), np.float32)
    factor = rng.normal(0, 0.01, (len(columns), rank)).astype(np.float32)
    due = (shrink * np.sqrt(inside * (1 - inside) * count[frequent]) / len(sets)).astype(np.float32)
    last, step = np.zeros(len(columns), np.int64), 0
    for epoch in range(epochs):
        order = rng.permutation(len(sets))
        pace = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            some = order[at:at + batch]
            y = labels[some]
            seen, place = np.unique(np.concatenate([column[edges[i]:edges[i + 1]] for i in some]), return_inverse=True)
            x = np.zeros((len(some), len(seen)), np.float32)
            x[np.repeat(np.arange(len(some)), edges[some + 1] - edges[some]), place] = 1
            step += 1
            gap = (step - last[seen]).astype(np.float32)
            last[seen] = step
            w, v = weight[seen], factor[seen]
            w = np.sign(w) * np.maximum(np.abs(w) - pace * gap * due[seen], 0)
            v = v * np.exp(-pace * decay * gap)[:, None]
            total = x @ v
            z = bias + x @ w + 0.5 * ((total ** 2).sum(1) - x @ (v ** 2).sum(1))
            d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)).astype(np.float32)
            alone = d @ x
            bias -= pace * float(d.sum())
            weight[seen] = w - pace * alone
            change = x.T @ (d[:, None] * total) - alone[:, None] * v
            factor[seen] = v - pace * change / np.maximum(1, np.sqrt((change ** 2).sum() / 0.01))
    weight = np.sign(weight) * np.maximum(np.abs(weight) - rate / epochs * (step - last) * due, 0)
    share = min(max(share, 1e-6), 1 - 1e-6)
    moved = np.log(share / (1 - share)) - np.log(inside / (1 - inside))
    return Machine(columns, bias + float(moved), weight.astype(float), factor.astype(float))


def trained(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Machine:
    """A machine from the labelled rows outside the held-out fold.

    Counts come from all such rows; the rows of the sample - at most ``2 * sample`` sets of hashed terms - are
    joined with their texts by a broadcast of that size and reach the driver, which fits.
    """
    known = (labels.filter(F.col(label).isNotNull() & (remainder("doc_id") != 0))
             .groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max(label).cast("int").alias("y")))
    count = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = count.get(0, 0), count.get(1, 0)
    part = F.pmod(F.xxhash64(F.lit("fit"), "id"), F.lit(1_000_000)) / 1_000_000
    rate = F.when(F.col("y") == 1, sample / max(n1, 1)).otherwise(sample / max(n0, 1))
    chosen = known.filter(part < rate * 0.95).limit(2 * sample)

    def run(batch):
        sets = [sorted(terms(t)) for t in batch.column("text").to_pylist()]
        return {"id": batch.column("doc_id"), "y": batch.column("y"), "terms": sets}

    rows = keyed(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("doc_id", "text", "y")
    got = sorted(map_arrow(rows, run, "id long, y int, terms array<int>").dropDuplicates(["id"]).collect())
    return fit([set(r["terms"]) for r in got], np.array([r["y"] for r in got], np.int64), n1 / (n0 + n1) if n0 + n1 else 0.5)


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """``doc_id``, row key, ``score`` and ``predicted`` of every document."""

    def run(batch):
        scores = [machine.score(terms(t)) for t in batch.column("text").to_pylist()]
        return {"doc_id": batch.column("doc_id"), KEY: batch.column(KEY), "score": scores, "predicted": [int(s >= 0.5) for s in scores]}

    return map_arrow(keyed(docs), run, f"doc_id long, {KEY} long, score double, predicted int")


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Fit on the labels and score every document; ``held_out`` says whose label the fit never saw."""
    out = scored(docs, trained(docs, labels, **options))
    return out.select("doc_id", (remainder("doc_id") == 0).alias("held_out"), "score", "predicted")
