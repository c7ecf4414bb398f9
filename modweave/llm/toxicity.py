"""Toxicity by a factorisation machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), with x_i = 1 for each distinct
hashed term of the text: a pair such as an insult with the mention of a group has a weight of its
own, which an additive model lacks. The model is fitted on a bounded sample of labelled rows; its
size is fixed by ``BUCKETS`` and ``FACTORS``.

Most terms tell nothing, alone or in pairs, and their noise would drown the pairs. So terms are
screened first, by tests that do not depend on how common they are: a term takes part if it tells
the labels apart, or if it does so among the documents that hold one of the most telling terms
(a mention that is neutral alone, next to an insult). Weights and factors then start at zero and
at small random numbers and are fitted together, the weights a few rounds ahead.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from modweave.runtime import cut

#: About so many labelled rows are used for training, picked by a hash of their id.
SAMPLE_ROWS = 16_000
BUCKETS = 1 << 18
FACTORS = 6
#: Rounds over the sample; in the first of them only weights move.
EPOCHS, AHEAD = 30, 5
#: Terms take part if they are in so many sampled documents and tell the labels apart by so many
#: standard errors, or do so by ``PAIRED`` among the documents of one of the ``ANCHORS`` most telling terms.
LEAST_DOCUMENTS, TELLING, PAIRED, ANCHORS = 4, 4.5, 6.0, 200
#: The sample is thinned, by the same hash, to about so many terms if its texts are very long.
SAMPLE_TERMS = 64_000_000
_STRIP = b".,;:!?\"'()[]{}<>#$%&*|-_"


class _Terms(dict):
    """Bucket of a raw word; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        at = self[word] = zlib.crc32(word.strip(_STRIP)) % BUCKETS
        return at


_terms = _Terms()


def terms(text: bytes) -> np.ndarray:
    """Distinct buckets of the lower-cased words of a text."""
    words = text.split()
    return np.unique(np.fromiter(map(_terms.__getitem__, words), np.int32, len(words)))


def screened(docs: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Whether each bucket takes part."""
    at, size = np.concatenate([*docs, np.zeros(0, np.int32)]), np.array([len(d) for d in docs], np.int64)
    seen, hits = np.bincount(at, minlength=BUCKETS), np.bincount(at, np.repeat(y, size), BUCKETS)
    p = min(max(float(np.mean(y)), 1e-4), 1 - 1e-4)
    z = np.abs(hits - p * seen) / np.sqrt(p * (1 - p) * np.maximum(seen, 1))
    known = seen >= LEAST_DOCUMENTS
    active = known & (z >= TELLING)
    order = np.argsort(at, kind="stable")
    holders, ends = np.repeat(np.arange(len(docs)), size)[order], np.cumsum(seen)
    anchors = np.flatnonzero(known & (2 * seen <= len(docs)))
    for a in anchors[np.argsort(-z[anchors], kind="stable")[:ANCHORS]]:
        own = holders[ends[a] - seen[a] : ends[a]]
        q = min(max(hits[a] / seen[a], 0.02), 0.98)
        beside = np.concatenate([docs[d] for d in own])
        n, s = np.bincount(beside, minlength=BUCKETS), np.bincount(beside, np.repeat(y[own] - q, size[own]), BUCKETS)
        paired = (n >= LEAST_DOCUMENTS) & (np.abs(s) >= PAIRED * np.sqrt(q * (1 - q) * n))
        paired[a] = False
        if paired.any():
            active |= paired
            active[a] = True
    return active


class Machine:
    """Weights ``w0``, ``w`` and factors ``v`` (a column for each factor)."""

    def __init__(self):
        self.w0, self.w = -3.0, np.zeros(BUCKETS, np.float32)
        self.v = np.zeros((BUCKETS, FACTORS), np.float32)

    def raw(self, at: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums of factors, of documents whose terms begin at ``starts``; none may be empty."""
        v = self.v[at]
        sums = np.add.reduceat(v, starts, axis=0)
        squares = np.add.reduceat(v * v, starts, axis=0)
        return self.w0 + np.add.reduceat(self.w[at], starts) + 0.5 * (sums * sums - squares).sum(1), sums

    def fit(self, docs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = 128, rate: float = 0.5, slow: float = 0.1, shrink: tuple[float, float] = (1e-5, 1e-3), start: float = 0.05) -> Machine:
        """Adagrad over minibatches, in an order fixed by a seed; weights and factors shrink to zero."""
        random = np.random.default_rng(7)
        y = np.asarray(y, np.float64)
        keep = screened(docs, y)
        p = min(max(float(np.mean(y)), 1e-4), 1 - 1e-4)
        self.w0 = float(np.log(p / (1 - p)))
        docs = [np.concatenate([d[keep[d]], [BUCKETS]]).astype(np.int64) for d in docs]  # the last bucket is a sentinel without weight
        w, v = np.zeros(BUCKETS + 1, np.float32), np.zeros((BUCKETS + 1, FACTORS), np.float32)
        v[:-1][keep] = random.normal(0, start, (int(keep.sum()), FACTORS))
        gw, gv, g0 = np.full(BUCKETS + 1, 1e-3, np.float32), np.full((BUCKETS + 1, FACTORS), 1e-2, np.float32), 1e-3
        self.w, self.v = w, v
        for epoch in range(epochs):
            order = random.permutation(len(docs))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                at = np.concatenate([docs[i] for i in own])
                size = np.array([len(docs[i]) for i in own])
                z, sums = self.raw(at, np.cumsum(size) - size)
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[own]).astype(np.float32)
                each = np.repeat(error, size)
                x, inverse, held = np.unique(at, return_inverse=True, return_counts=True)
                dw = np.bincount(inverse, each) / len(own) + shrink[0] * w[x]
                gw[x] += dw**2
                w[x] -= (rate * dw / np.sqrt(gw[x])).astype(np.float32)
                if epoch >= AHEAD:
                    grad = each[:, None] * (np.repeat(sums, size, axis=0) - v[at])
                    # over the documents that hold the term: over the batch, factors of rare terms would never leave zero
                    dv = np.stack([np.bincount(inverse, grad[:, f]) for f in range(FACTORS)], 1) / held[:, None] + shrink[1] * v[x]
                    gv[x] += dv**2
                    v[x] -= (slow * rate * dv / np.sqrt(gv[x])).astype(np.float32)
                w[-1], v[-1] = 0, 0
                d0 = float(error.mean())
                g0 += d0 * d0
                self.w0 -= rate * d0 / g0**0.5
        self.w, self.v = w[:-1].copy(), v[:-1].copy()
        return self

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text."""
        out = np.zeros(len(texts))
        for k in range(0, len(texts), 512):
            docs = [np.append(terms(t), 0) for t in texts[k : k + 512]]
            size = np.array([len(d) for d in docs])
            at, starts = np.concatenate(docs), np.cumsum(size) - size
            w, v = self.w[at], self.v[at]
            w[starts + size - 1], v[starts + size - 1] = 0, 0
            sums = np.add.reduceat(v, starts, axis=0)
            z = self.w0 + np.add.reduceat(w, starts) + 0.5 * (sums * sums - np.add.reduceat(v * v, starts, axis=0)).sum(1)
            out[k : k + 512] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE_ROWS) -> Machine:
    """Fit on about ``sample`` rows that have a label of 0 or 1.

    A null text counts as empty, and a long one has each of its terms once; ids with several labels
    take the highest; labels without a document, and null ids, are not used; documents that repeat
    an id are all used. Without any labelled row, as in empty tables, all scores are the prior's.
    Other columns, whatever their names, are not read.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("y")).filter("y IN (0, 1) AND _id IS NOT NULL").groupBy("_id").agg(F.max("y").cast("int").alias("y"))
    share = min(1 << 20, (sample << 20) // max(1, known.count()))
    picked = F.broadcast(known.filter(F.pmod(F.xxhash64(F.lit("toxicity"), "_id"), F.lit(1 << 20)) < share))  # about ``sample`` rows
    text = F.coalesce(F.lower(F.col(text_col)), F.lit("")).cast("binary")

    def hashed(batches):
        for frame in batches:
            yield pd.DataFrame({"y": frame["y"], "terms": [terms(t).tobytes() for t in frame["data"]], "key": frame["key"]})

    read = docs.select(F.col(id_col).alias("_id"), text.alias("data"), F.xxhash64(id_col, text_col).alias("key"))
    found = cut(read.join(picked, "_id").select("y", "data", "key").mapInPandas(hashed, "y int, terms binary, key long"))
    many = (found.agg(F.sum(F.octet_length("terms").cast("long"))).first()[0] or 0) // 4
    if many > SAMPLE_TERMS:
        found = found.filter(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < (SAMPLE_TERMS << 20) // many)
    rows = found.toPandas().sort_values(["key", "y"], kind="stable")
    machine = Machine()
    return machine.fit([np.frombuffer(t, np.int32) for t in rows["terms"]], rows["y"].to_numpy()) if len(rows) else machine


def toxicity(docs: DataFrame, machine: Machine, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1) and predicted (1 at ``threshold`` or more).

    Only the text is read; a null text scores as an empty one, repeated rows get the same, and a long
    text has each of its terms once. Columns of these two names are replaced, all others are kept.
    Empty input gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts.tolist()))

    udf = F.pandas_udf(score, "double")
    value = udf(F.coalesce(F.lower(F.col(text_col)), F.lit("")).cast("binary"))
    scored = docs.select(*(docs[c] for c in docs.columns if c not in ("score", "predicted")), value.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
