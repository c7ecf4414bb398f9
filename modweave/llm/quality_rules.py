"""Quality rules: gradient-boosted trees over document statistics.

Trees are fitted on a bounded sample of labelled documents with histograms, under monotonic
constraints (more symbols, repeats or capitals never raise the score), and flattened into numpy
arrays of features, thresholds and values, so that scoring is a few vectorised comparisons.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: About so many labelled rows are used for training, picked by a hash of their id.
SAMPLE_ROWS = 16_000
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct", "n_upper", "n_digits", "n_bangs"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "digits", "distinct", "bangs"]
#: -1: the score may not rise with the feature; 0: free.
MONOTONE = [0, 0, -1, -1, -1, -1, 0, 0, -1]


def _repeated(ids: np.ndarray, kinds: int) -> int:
    """Words in 3-word windows that occur twice or more."""
    n = len(ids)
    if n < 4:
        return 0
    pair = ids[:-1] * kinds + ids[1:]
    if kinds > 2_000_000:
        pair = np.unique(pair, return_inverse=True)[1]
    code = pair[:-1] * kinds + ids[2:]
    _, inverse, counts = np.unique(code, return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= twice
    return int(covered.sum())


def statistics(text: bytes | None) -> list[int]:
    """The counts named in ``STATS``; all zero for a null text."""
    if not text:
        return [0] * len(STATS)
    words = text.split()
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    without = lambda drop: len(text) - len(text.translate(None, drop))
    chars = len(text.decode())
    return [len(words), chars - without(SPACES), without(SYMBOLS), len(lines) - len(set(lines)), _repeated(ids, max(1, len(known))), len(lines), len(known), without(UPPER), without(DIGITS), text.count(b"!")]


def features(stats: np.ndarray) -> np.ndarray:
    """(documents, len(FEATURES)) from (documents, len(STATS)) counts."""
    s = stats.astype(np.float64)
    words, chars, lines = np.maximum(1, s[:, 0]), np.maximum(1, s[:, 1]), np.maximum(1, s[:, 5])
    return np.stack([np.log1p(s[:, 0]), s[:, 1] / words, s[:, 2] / words, s[:, 3] / lines, s[:, 4] / words, s[:, 7] / chars, s[:, 8] / chars, s[:, 6] / words, s[:, 9] / words], 1)


class Trees:
    """Complete binary trees of equal depth as flat arrays (trees, nodes)."""

    def __init__(self, depth: int, prior: float):
        self.depth, self.prior = depth, prior
        self.feature, self.cut, self.value = (np.zeros((0, 2**depth - 1), np.int32), np.zeros((0, 2**depth - 1)), np.zeros((0, 2**depth)))

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.prior), np.arange(len(x))
        for feature, cut, value in zip(self.feature, self.cut, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            out += value[at - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, damp: float = 5.0) -> Trees:
    """Logistic boosting by second-order histogram splits; leaves are kept within monotonic bounds."""
    p = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Trees(depth, float(np.log(p / (1 - p))))
    if not len(y) or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f]) for f, c in enumerate(cuts)], 1)
    raw = np.full(len(y), model.prior)
    grown = []
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, np.maximum(prob * (1 - prob), 1e-6)
        feature, cut = np.zeros(2**depth - 1, np.int32), np.full(2**depth - 1, np.inf)
        low, high = np.full(2 ** (depth + 1) - 1, -np.inf), np.full(2 ** (depth + 1) - 1, np.inf)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first = 2**level - 1
            nodes = 2**level
            sums_g, sums_h = (np.bincount(at - first, v, nodes) for v in (g, h))
            best = np.full(nodes, 1e-6)
            split = np.full(nodes, -1)
            for f, c in enumerate(cuts):
                width = len(c) + 1
                if width < 2:
                    continue
                cell = (at - first) * width + binned[:, f]
                lg = np.cumsum(np.bincount(cell, g, nodes * width).reshape(nodes, width), 1)[:, :-1]
                lh = np.cumsum(np.bincount(cell, h, nodes * width).reshape(nodes, width), 1)[:, :-1]
                rg, rh = sums_g[:, None] - lg, sums_h[:, None] - lh
                lo, hi = low[first : first + nodes, None], high[first : first + nodes, None]
                lv, rv = (np.clip(-a / (b + damp), lo, hi) for a, b in ((lg, lh), (rg, rh)))
                own = np.clip(-sums_g / (sums_h + damp), lo[:, 0], hi[:, 0])[:, None]
                gain_of = lambda a, b, v: -(a * v + 0.5 * (b + damp) * v * v)
                gain = gain_of(lg, lh, lv) + gain_of(rg, rh, rv) - gain_of(sums_g[:, None], sums_h[:, None], own)
                bad = (lh < 3) | (rh < 3)
                if monotone[f]:
                    bad |= (rv - lv) * monotone[f] < 0
                gain = np.where(bad, -np.inf, gain)
                k = gain.argmax(1)
                top = gain[np.arange(nodes), k]
                for node in np.flatnonzero(top > best):
                    best[node], split[node] = top[node], f
                    feature[first + node], cut[first + node] = f, c[k[node]]
                    middle = (lv[node, k[node]] + rv[node, k[node]]) / 2
                    for child in (1, 2):
                        kid = 2 * (first + node) + child
                        low[kid], high[kid] = low[first + node], high[first + node]
                    if monotone[f]:
                        lower, upper = 2 * (first + node) + (1 if monotone[f] > 0 else 2), 2 * (first + node) + (2 if monotone[f] > 0 else 1)
                        high[lower], low[upper] = min(high[lower], middle), max(low[upper], middle)
            for node in np.flatnonzero(split < 0):
                for child in (1, 2):
                    kid = 2 * (first + node) + child
                    low[kid], high[kid] = low[first + node], high[first + node]
            at = 2 * at + 1 + (x[np.arange(len(y)), feature[at]] > cut[at])
        leaf = at - (2**depth - 1)
        value = -np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + damp)
        value = rate * np.clip(value, low[2**depth - 1 :], high[2**depth - 1 :])
        grown.append((feature, cut, value))
        raw += value[leaf]
    model.feature, model.cut, model.value = (np.stack(v) for v in zip(*grown, strict=True))
    return model


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE_ROWS) -> Trees:
    """Fit on about ``sample`` rows labelled 0 or 1; without any the score is 0.5 everywhere.

    A null text counts as empty; ids with several labels take the lowest; null ids and labels
    without a document are not used; documents that repeat an id are all used, and ties in all
    counts are alike. Other columns, whatever their names, are not read.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).alias("y")).filter("y IN (0, 1) AND _id IS NOT NULL").groupBy("_id").agg(F.min("y").cast("int").alias("y"))
    share = min(1 << 20, (sample << 20) // max(1, known.count()))
    picked = F.broadcast(known.filter(F.pmod(F.xxhash64(F.lit("quality"), "_id"), F.lit(1 << 20)) < share))  # about ``sample`` rows
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("binary").alias("data"))
    rows = read.join(picked, "_id").select("y", "data")
    found = rows.mapInArrow(_counts("y", None), ", ".join(["y int", *(f"{c} long" for c in STATS)])).toPandas().sort_values(["y", *STATS])
    return fit(features(found[STATS].to_numpy()), found["y"].to_numpy(np.float64), MONOTONE)


def _counts(name: str, shared):
    """Map batches of (name, data) to name, the counts, and with a model its score."""

    def run(batches):
        for batch in batches:
            stats = np.array([statistics(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(STATS))
            arrays = [batch.column(0), *(pa.array(stats[:, k]) for k in range(len(STATS)))]
            if shared is not None:
                arrays.append(pa.array(shared.value.score(features(stats))))
            yield pa.RecordBatch.from_arrays(arrays, names=[name, *STATS, *(["score"] if shared is not None else [])])

    return run


def rules(docs: DataFrame, model: Trees, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """A row per row of ``docs``: id, counts, base_failed, score and kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: not
    base_failed and a score of at least ``threshold``. A null text has no words. Repeated rows and
    null ids are kept; empty input gives no rows; a long text is counted in one pass. Other columns,
    whatever their names, are not read.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select(id_col, F.col(text_col).cast("binary").alias("data")).mapInArrow(_counts(id_col, shared), ", ".join([f"`{id_col}` {kind}", *(f"{c} long" for c in STATS), "score double"]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(id_col, *STATS, failed.alias("base_failed"), "score", (~failed & (F.col("score") >= threshold)).alias("kept"))
