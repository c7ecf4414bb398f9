"""Soft-membership mixing to target weights, in DataFrame functions only.

A naive Bayes classifier, counted over a labelled table, gives each document posteriors over the
domains: a document may belong to several domains in part. Every word (hashed to ``BUCKETS``, so
the table of likelihoods has a fixed size) and three statistics of the text are evidence; how much
the evidence is trusted is fitted on labelled rows that did not train it. Documents meet the table
word by word, in a join whose rows are summed again where they are made.

Projected gradient steps then fit a non-negative rate for each document so that the expected
domain totals of tokens match the targets in the least-squares sense. A document's step depends
on its posteriors alone, so documents of nearly equal posteriors are summed first, each step is one
small aggregation, and the rate is a function of the posteriors and the residuals of the steps.
"""

from __future__ import annotations

import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from modweave.runtime import cut

#: Words are hashed to so many buckets, and a bucket's documents in a domain are drawn to those expected by so many.
BUCKETS, PRIOR = 1 << 18, 1.0
#: Factors up to this are no evidence: many common words repeat each other's small leanings, as towards a language.
LIFT = 3.0
#: Newton steps at most that calibrate the posteriors, the step that ends them, and the weight that holds their parameters.
ROUNDS, SETTLED, RIDGE = 12, 1e-3, 1.0
#: About so many labelled rows train it, picked by a hash of their id.
SAMPLE_ROWS = 16_000
#: Posteriors within a cell of this grid are summed, with their mean, before the steps.
GRID = 1000
#: Steps end when the goals are met or nothing changes; a warning tells if neither happened by the last.
STEPS, TOLERANCE = 500, 1e-3
SIGNS = r"[#*$%&|<>]"
BREAKS = r"[\s.,!?;:\"'()#*$%&|<>]+"
#: Upper bounds of the classes of each statistic.
CLASSES = {"signs": [0.0, 0.1, 0.5], "bangs": [0.0, 0.1, 0.5], "fresh": [0.2, 0.4, 0.7], "capitals": [0.1, 0.3, 0.6, 1.5, 3.0], "words": [9, 24, 49, 99]}
#: Keys to copies are broadcast up to this many rows, and joined by a shuffle beyond; the result is the same.
BROADCAST_ROWS = 200_000


def profile(rows: DataFrame) -> DataFrame:
    """``rows``, whose column ``_text`` is the text, without it, with ``tokens`` and ``_buckets``: those of distinct words and of classes.

    A null or empty text has no tokens and no buckets.
    """
    rest, text = [c for c in rows.columns if c != "_text"], F.coalesce("_text", F.lit(""))
    signs = {k: F.regexp_count(text, F.lit(x)).alias(f"_{k}") for k, x in {"signs": SIGNS, "bangs": "!", "capitals": "[A-Z]"}.items()}
    a = rows.select(*rest, F.array_remove(F.split(F.lower(text), BREAKS), "").alias("_words"), *signs.values())
    b = a.select(*rest, F.size("_words").cast("long").alias("tokens"), F.array_distinct("_words").alias("_words"), *(f"_{k}" for k in signs))
    each = F.greatest(F.lit(1), "tokens")
    share = {k: F.col(f"_{k}") / each for k in signs} | {"fresh": F.size("_words") / each, "words": F.col("tokens")}
    kind = {k: sum(((x > bound).cast("int") for bound in CLASSES[k]), F.lit(0)) for k, x in share.items()}
    classes = F.array(*(F.concat(F.lit(f" {k} "), kind[k].cast("string")) for k in CLASSES))  # words have no blanks
    every = F.when(F.col("tokens") > 0, F.concat("_words", classes)).otherwise(F.array().cast("array<string>"))
    return b.select(*rest, "tokens", F.transform(every, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS).cast("long"))).alias("_buckets"))


class Classifier:
    """``domains``, a bias for each, ``table`` (bucket, e0, e1, ...: evidence for each domain) and the weight of the evidence."""

    def __init__(self, domains: list[str], base: list[float], table: DataFrame | None, weight: float = 1.0):
        self.domains, self.base, self.table, self.weight = domains, base, table, weight

    def sums(self, rows: DataFrame) -> DataFrame:
        """A profile without its buckets, with s0, s1, ...: the sum of a row's evidence. Rows need not differ."""
        keys = [c for c in rows.columns if c != "_buckets"]
        named = rows.select(F.monotonically_increasing_id().alias("_row"), "*")  # before the rows are taken apart
        each = named.select("_row", *keys, F.explode_outer("_buckets").alias("bucket"))
        met = each.join(F.broadcast(self.table), "bucket", "left")  # a row for each bucket at most
        return met.groupBy("_row", *keys).agg(*(F.coalesce(F.sum(f"e{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(len(self.domains)))).drop("_row")

    def softmax(self, base: list[float], weight: float) -> Column:
        """Posteriors from s0, s1, ..."""
        z = F.array(*(F.lit(b) + F.col(f"s{k}") * weight for k, b in enumerate(base)))
        raised = F.transform(z, lambda x: F.exp(x - F.array_max(z)))
        return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))

    def scored(self, rows: DataFrame) -> DataFrame:
        """A profile without its buckets, with q: posteriors in the order of the domains."""
        if not self.domains:
            return rows.drop("_buckets").withColumn("q", F.array(F.lit(1.0)))
        return self.sums(rows).withColumn("q", self.softmax(self.base, self.weight)).drop(*(f"s{k}" for k in range(len(self.domains))))


def _table(rows: DataFrame, domains: list[str], sizes: dict[str, int]) -> DataFrame:
    """(bucket, e0, e1, ...): log of a bucket's documents in each domain over those expected, drawn to zero where they are few, beyond ``LIFT``."""
    n, ks = sum(sizes.values()), range(len(domains))
    counted = rows.select("domain", F.explode(F.array_distinct("_buckets")).alias("bucket")).groupBy("bucket").agg(*(F.count_if(F.col("domain") == d).alias(f"n{k}") for k, d in enumerate(domains)))
    overall = sum((F.col(f"n{k}") for k in ks), F.lit(0)) / float(n)
    lean = lambda x: F.signum(x) * F.greatest(F.lit(0.0), F.abs(x) - math.log(LIFT))
    found = counted.select("bucket", *(lean(F.log((F.col(f"n{k}") + PRIOR) / (sizes[d] * overall + PRIOR))).alias(f"e{k}") for k, d in enumerate(domains)))
    return cut(found.filter(F.greatest(*(F.abs(f"e{k}") for k in ks), F.lit(0.0)) > 0))


def _calibrated(classifier: Classifier, rows: DataFrame, steps: int = ROUNDS) -> tuple[list[float], float]:
    """Biases and the weight of the evidence with the least loss on rows (domain, _buckets), by Newton's method; each step is one aggregation."""
    ks = range(len(classifier.domains))
    own = [(F.col("domain") == d).cast("double") for d in classifier.domains]
    rows = cut(classifier.sums(rows).select(*(x.alias(f"y{k}") for k, x in enumerate(own)), *(f"s{k}" for k in ks)))
    base, weight, last = list(classifier.base), 1.0, None
    value = [*base, weight]
    for _ in range(steps):
        q = [F.element_at(classifier.softmax(value[:-1], value[-1]), k + 1) for k in ks]
        read = rows.select("*", *(x.alias(f"q{k}") for k, x in enumerate(q)))
        mean = sum((F.col(f"q{k}") * F.col(f"s{k}") for k in ks), F.lit(0.0))
        sums = [F.sum(F.col(f"q{k}") - F.col(f"y{k}")) for k in ks] + [F.sum(sum(((F.col(f"q{k}") - F.col(f"y{k}")) * F.col(f"s{k}") for k in ks), F.lit(0.0)))]
        sums += [F.sum(F.col(f"q{i}") * (float(i == j) - F.col(f"q{j}"))) for i in ks for j in ks]
        sums += [F.sum(F.col(f"q{k}") * (F.col(f"s{k}") - mean)) for k in ks] + [F.sum(sum((F.col(f"q{k}") * F.col(f"s{k}") * (F.col(f"s{k}") - mean) for k in ks), F.lit(0.0)))]
        sums += [F.sum(sum((-F.col(f"y{k}") * F.log(F.greatest(F.lit(1e-12), F.col(f"q{k}"))) for k in ks), F.lit(0.0)))]
        got = [x or 0.0 for x in read.agg(*(c.alias(f"c{i}") for i, c in enumerate(sums))).first()]
        n = len(classifier.domains)
        slope, bend, loss = np.array(got[: n + 1]), np.zeros((n + 1, n + 1)), got[-1]
        bend[:n, :n] = np.array(got[n + 1 : n + 1 + n * n]).reshape(n, n)
        bend[:n, n] = bend[n, :n] = got[n + 1 + n * n : -2]
        bend[n, n] = got[-2]
        step = np.linalg.solve(bend + RIDGE * np.eye(n + 1), slope + RIDGE * (np.array(value) - [*base, 1.0]))
        if last is not None and loss > last[0]:  # too far: back, and half as far
            value, step = [(a + b) / 2 for a, b in zip(value, last[1], strict=True)], None
        else:
            last = (loss, value)
            if np.abs(step).max() < SETTLED:
                break
            value = [a - float(np.clip(b, -2, 2)) for a, b in zip(value, step, strict=True)]
        value[-1] = max(value[-1], 0.01)
    return last[1][:-1], last[1][-1]


def train(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", sample: int = SAMPLE_ROWS) -> Classifier:
    """Count evidence by domain over about ``sample`` rows of the labelled table (id, domain).

    Biases and the weight of the evidence are fitted on the half that a first table is not counted
    on, so posteriors mean what they say. Null ids and domains are left out; an id with several domains counts in each; ids without
    a document do not count; null and empty texts have no evidence; documents that repeat an id all
    count. Without a labelled row, as in empty tables, there are no domains. Other columns,
    whatever their names, are not read.
    """
    known = labelled.select(F.col(id_col).alias("_id"), F.col(domain_col).alias("domain")).filter("_id IS NOT NULL AND domain IS NOT NULL").distinct()
    share = min(1 << 20, (sample << 20) // max(1, known.count()))
    picked = F.broadcast(known.filter(F.pmod(F.xxhash64(F.lit("mixing"), "_id"), F.lit(1 << 20)) < share))  # about ``sample`` rows
    read = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(picked, "_id")
    rows = cut(profile(read.select("domain", (F.pmod(F.xxhash64(F.lit("half"), "_id"), F.lit(2)) == 0).alias("half"), "_text")))
    counts = rows.groupBy("domain").agg(F.count("*").alias("n"), F.count_if("half").alias("half")).collect()
    sizes, halves = ({r["domain"]: r[c] for r in counts} for c in ("n", "half"))
    domains = sorted(sizes)
    if not domains:
        return Classifier([], [], None)
    base = [math.log(sizes[d] / sum(sizes.values())) for d in domains]
    weight = 1.0
    if len(domains) > 1 and all(0 < halves[d] < sizes[d] for d in domains):
        first = Classifier(domains, base, _table(rows.filter("half"), domains, halves))
        base, weight = _calibrated(first, rows.filter("NOT half").select("domain", "_buckets"))
    return Classifier(domains, base, _table(rows, domains, sizes), weight)


def _states(history: list[list[float]]) -> Column:
    """Struct of the rate ``r`` and the one before, ``p``, of a row with posteriors ``q`` after the steps of ``history``.

    A step is its momentum and then a move for each domain. Rates begin at 1.
    """
    steps = F.expr(f"cast(array({', '.join(f'array({", ".join(f"{x!r}D" for x in h)})' for h in history)}) as array<array<double>>)")
    dot = lambda h: F.aggregate(F.zip_with("q", F.slice(h, 2, F.size(h) - 1), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    start = F.struct(F.lit(1.0).alias("r"), F.lit(1.0).alias("p"))
    return F.aggregate(steps, start, lambda s, h: F.struct(F.greatest(F.lit(0.0), s["r"] + h[0] * (s["r"] - s["p"]) - dot(h)).alias("r"), s["r"].alias("p")))


def _rate(history: list[list[float]]) -> Column:
    return _states(history)["r"]


def fit_rates(profiles: DataFrame, goals: list[float], steps: int = STEPS, tolerance: float = TOLERANCE) -> list[list[float]]:
    """Projected gradient steps for rows (q, tokens), so that sum(rate * tokens * q[k]) nears goals[k].

    Residuals are scaled by the diagonal of the Gram matrix, and the step length is the inverse of
    a bound on the scaled matrix's norm; momentum speeds the steps up and starts anew when the
    residual grows. It ends when the goals are met or, where rates of zero keep them out of reach,
    when the residuals no longer change; :func:`totals` tells what is reached. No rows, or no
    tokens, give no steps, which are rates of 1.
    """
    ks = range(len(goals))
    shares = profiles.select("tokens", "q", F.posexplode("q").alias("i", "x")).groupBy("i").agg(*(F.sum(F.col("tokens") * F.col("x") * F.element_at("q", j + 1)).alias(f"g{j}") for j in ks)).collect()
    gram = {r["i"]: [r[f"g{j}"] or 0.0 for j in ks] for r in shares}
    if len(gram) < len(goals):
        return []
    scale = [1 / gram[i][i] if gram[i][i] > 0 else 0.0 for i in ks]
    norm = max(sum(abs(gram[i][j]) * (scale[i] * scale[j]) ** 0.5 for j in ks) for i in ks)
    if norm <= 0:
        return []
    history: list[list[float]] = []
    bar = tolerance * (sum(goals) or 1.0) / len(goals)
    t, beta, last = 1.0, 0.0, None
    for _ in range(steps):
        ahead = F.col("s.r") + beta * (F.col("s.r") - F.col("s.p"))
        rated = profiles.select("tokens", "q", _states(history).alias("s")).select((F.col("tokens") * ahead).alias("t"), F.posexplode("q").alias("i", "x"))
        got = {r["i"]: r["s"] for r in rated.groupBy("i").agg(F.sum(F.col("t") * F.col("x")).alias("s")).collect()}
        off = [(got[i] - goals[i]) if scale[i] else 0.0 for i in ks]
        size = sum(scale[i] * off[i] ** 2 for i in ks)
        if max(map(abs, off)) <= bar or last and max(abs(a - b) for a, b in zip(off, last[1], strict=True)) <= bar / 20:
            break
        history.append([beta, *(scale[i] * off[i] / norm for i in ks)])
        if last and size > last[0]:
            t = 1.0
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        beta, t, last = (t - 1) / after, after, (size, off)
    else:
        warnings.warn(f"the rates have not settled after {steps} steps: residuals {off} of {goals}", stacklevel=2)
    return history


def _scored(docs: DataFrame, classifier: Classifier, id_col: str, text_col: str) -> DataFrame:
    """(_id, _hash, tokens, q) of every row."""
    return classifier.scored(profile(docs.select(F.col(id_col).alias("_id"), F.xxhash64(id_col, text_col).alias("_hash"), F.col(text_col).alias("_text"))))


def _solve(found: DataFrame, classifier: Classifier, targets: dict[str, float], total: float | None) -> list[list[float]]:
    if len(classifier.domains) < 2:
        return []
    ks = range(len(classifier.domains))
    cells = found.groupBy(*(F.floor(F.element_at("q", k + 1) * GRID).alias(f"c{k}") for k in ks)).agg(F.sum("tokens").cast("double").alias("tokens"), *(F.sum(F.col("tokens") * F.element_at("q", k + 1)).alias(f"t{k}") for k in ks))
    profiles = cut(cells.filter("tokens > 0").select("tokens", F.array(*(F.col(f"t{k}") / F.col("tokens") for k in ks)).alias("q")))
    have = profiles.agg(F.sum("tokens")).first()[0] or 0.0
    whole = sum(targets.get(d, 0.0) for d in classifier.domains)
    if whole <= 0 or have <= 0:
        return []
    return fit_rates(profiles, [float(targets.get(d, 0.0) / whole * (total or have)) for d in classifier.domains])


def _copies() -> Column:
    """The rate, rounded up or down by a hash of id and text, so that its mean is the rate."""
    part = F.pmod(F.xxhash64(F.lit("copies"), "_hash"), F.lit(1 << 30)) / float(1 << 30)
    return (F.floor("rate") + (part < F.col("rate") - F.floor("rate")).cast("long")).cast("long")


def mix(docs: DataFrame, classifier: Classifier, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", total: float | None = None) -> DataFrame:
    """A row per row of ``docs``: id, tokens, q (posteriors in the order of domains), rate and copies.

    ``targets`` are weights of domains (scaled to 1) and ``total`` the wanted tokens (default: those
    of ``docs``). A null or empty text has no tokens and the priors as posteriors. Rows that repeat
    get the same; null ids are kept. No domains, or no tokens, give rate 1 and one copy. Equal
    posteriors have equal rates. Long texts are read once. Other columns, whatever their names, are
    not read; empty input gives no rows.
    """
    found = cut(_scored(docs, classifier, id_col, text_col))
    history = _solve(found, classifier, targets, total)
    return found.withColumn("rate", _rate(history)).select(F.col("_id").alias(id_col), "tokens", "q", "rate", _copies().alias("copies"))


def totals(mixed: DataFrame, classifier: Classifier, targets: dict[str, float]) -> DataFrame:
    """(domain, wanted, reached): shares of the expected tokens of the rows of :func:`mix`. No rows give null shares."""
    whole = sum(targets.get(d, 0.0) for d in classifier.domains) or 1.0
    sums = mixed.agg(*(F.sum(F.col("rate") * F.col("tokens") * F.element_at("q", k + 1)).alias(f"t{k}") for k in range(len(classifier.domains))))
    every = sum((F.col(f"t{k}") for k in range(len(classifier.domains))), F.lit(0.0))
    each = F.array(*(F.struct(F.lit(d).alias("domain"), F.lit(targets.get(d, 0.0) / whole).alias("wanted"), (F.col(f"t{k}") / every).alias("reached")) for k, d in enumerate(classifier.domains)))
    return sums.select(F.explode(each).alias("x")).select("x.*")


def resample(docs: DataFrame, classifier: Classifier, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", total: float | None = None) -> DataFrame:
    """``docs`` with every row as often as :func:`mix` says (rates far above 1 give as many copies).

    Rows meet their copies by id and a hash of id and text; all columns keep their names, order and
    values, whatever the names are. Null, empty, long and repeated rows, and empty input, as there.
    """
    found = cut(_scored(docs, classifier, id_col, text_col))
    history = _solve(found, classifier, targets, total)
    of = found.withColumn("rate", _rate(history)).select("_hash", _copies().alias("copies")).filter("copies <> 1").distinct()
    of = cut(of.groupBy("_hash").agg(F.max("copies").alias("copies")))
    of = F.broadcast(of) if of.count() <= BROADCAST_ROWS else of
    rows = docs.select(F.xxhash64(id_col, text_col).alias("_hash"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_kept")).join(of, "_hash", "left")
    one = F.coalesce("copies", F.lit(1)).cast("int")
    return rows.select("_kept", F.explode(F.sequence(F.lit(1), F.greatest(one, F.lit(1)))).alias("_copy"), one.alias("_n")).filter("_n > 0").select("_kept.*")
