"""Bottleneck scores: how much of the graph meets in a module, upwards and downwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from modweave.operators.components import connected_components
from modweave.runtime import cut

#: What every relation adds, and the score of a node that is entered again inside a cycle.
RELATION, REENTERED = 0.1, 100.0
#: A range of so many scores is sorted.
SORTED = 10_000


def _direction(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, weight, sum) where src relates to dst.

    No relations give (1, 1); else weight = sum(weight(r) / inverse(r) + 0.1) and sum = sum(sum(r)
    + 0.1). Level by level, a node is scored in the round when all its relations are; cyclic rests
    are scored by component with an exact depth-first walk.
    """
    inverse = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("inv"))
    rest = cut(edges.join(inverse.withColumnRenamed("node", "dst"), "dst").select("src", "dst", "inv"))
    scored = cut(nodes.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("node", F.lit(1.0).alias("weight"), F.lit(1.0).alias("sum")))
    open_edges = rest
    while True:
        known = scored.select(F.col("node").alias("dst"), "weight", "sum")
        ready = open_edges.join(known, "dst", "left").groupBy("src").agg(F.count_if(F.col("weight").isNull()).alias("missing"), F.sum(F.col("weight") / F.col("inv") + RELATION).alias("weight"), F.sum(F.col("sum") + RELATION).alias("sum"))
        fresh = cut(ready.filter("missing = 0").select(F.col("src").alias("node"), "weight", "sum"))
        if fresh.isEmpty():
            break
        scored = cut(scored.unionByName(fresh))
        open_edges = cut(open_edges.join(fresh.select(F.col("node").alias("src")), "src", "left_anti"))
    if open_edges.isEmpty():
        return scored
    return scored.unionByName(_cyclic(open_edges, scored))


def _cyclic(open_edges: DataFrame, scored: DataFrame) -> DataFrame:
    """Scores of nodes on or above cycles, each weak component of them in one walk."""
    import pandas as pd

    inner = connected_components(open_edges.join(open_edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
    known = scored.select(F.col("node").alias("dst"), "weight", "sum")
    rows = open_edges.join(known, "dst", "left").join(inner.select(F.col("node").alias("src"), "component"), "src", "left").withColumn("component", F.coalesce("component", "src"))
    kind = open_edges.schema["src"].dataType.simpleString()

    def walk(frame: pd.DataFrame) -> pd.DataFrame:
        relations: dict = {}
        for a, b in zip(frame["src"], frame["dst"], strict=True):
            relations.setdefault(a, []).append(b)
        inverse = {b: range(int(n)) for b, n in zip(frame["dst"], frame["inv"], strict=True)}
        fixed = {b: (w, s) for b, w, s in zip(frame["dst"], frame["weight"], frame["sum"], strict=True) if not pd.isna(w)}
        names = sorted(relations)
        score = _exact(names, relations, inverse, fixed)
        return pd.DataFrame({"node": names, "weight": [score[n][0] for n in names], "sum": [score[n][1] for n in names]})

    return rows.groupBy("component").applyInPandas(walk, f"node {kind}, weight double, sum double")


def _exact(names: list, relations: dict, inverse: dict, fixed: dict) -> dict:
    """Depth-first scores of a small cyclic part; children and starts in ascending order.

    A node met again while its own score is still open counts as (100, 100); the score it gets
    when it closes replaces that. ``fixed`` has scores that are known before.
    """
    score = dict(fixed)
    for start in names:
        if start in score:
            continue
        score[start] = (REENTERED, REENTERED)
        stack = [[start, iter(sorted(relations.get(start, ()))), 0.0, 0.0]]
        while stack:
            frame = stack[-1]
            child = next(frame[1], None)
            if child is not None and child not in score:
                score[child] = (REENTERED, REENTERED)
                stack.append([child, iter(sorted(relations.get(child, ()))), 0.0, 0.0])
                continue
            if child is None:
                child = frame[0]
                score[child] = (frame[2], frame[3])
                stack.pop()
                if not stack:
                    break
                frame = stack[-1]
            frame[2] += score[child][0] / len(inverse[child]) + RELATION
            frame[3] += score[child][1] + RELATION
    return score


def scores(edges: DataFrame) -> DataFrame:
    """(node, up_weight, up_sum, down_weight, down_sum, badness) of every node of distinct edges.

    Up follows importers, down follows imports; badness = (up_weight - 1) * (down_weight - 1).
    """
    e = cut(edges.select("src", "dst").filter("src <> dst").distinct())
    nodes = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()
    down = _direction(e, nodes).select("node", F.col("weight").alias("down_weight"), F.col("sum").alias("down_sum"))
    up = _direction(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes).select("node", F.col("weight").alias("up_weight"), F.col("sum").alias("up_sum"))
    return up.join(down, "node").withColumn("badness", (F.col("up_weight") - 1) * (F.col("down_weight") - 1))


def hottest(scored: DataFrame, n: int = 10) -> DataFrame:
    """(node, badness) of the n worst, rounded half up; ties by node."""
    return scored.orderBy(F.desc("badness"), "node").limit(n).select("node", F.floor(F.col("badness") + 0.5).cast("long").alias("badness"))


def spread(scored: DataFrame) -> DataFrame:
    """(least, middle, most) badness; middle is the upper median, found in ever smaller ranges. No rows give none."""
    values = cut(scored.select("badness"))
    n, least, most = values.agg(F.count("*"), F.min("badness"), F.max("badness")).first()
    k, low, high, before = n // 2, least, most, 0
    while n and low < high:  # the middle lies in [low, high], after so many below
        inside = values.filter(F.col("badness").between(low, high))
        size = inside.count()
        if size <= SORTED:
            break
        share = (k - before) / size
        a, b = inside.agg(F.percentile_approx("badness", [max(0.0, share - 0.01), min(1.0, share + 0.01)], 1000)).first()[0]
        under, upto = values.agg(F.count_if(F.col("badness") < a), F.count_if(F.col("badness") <= b)).first()
        if (a, b) == (low, high) or not under <= k < upto:
            break
        low, high, before = a, b, under
    middle = low
    if n and low < high:
        middle = values.filter(F.col("badness").between(low, high)).orderBy("badness").offset(k - before).limit(1).first()[0]
    return scored.sparkSession.createDataFrame([(least, middle, most)] if n else [], "least double, middle double, most double")


def best_next(edges: DataFrame, scored: DataFrame) -> DataFrame:
    """(node, up_next, down_next): the importer of best up_sum and the import of best down_sum, the least of equals."""
    s = scored.select("node", "up_sum", "down_sum")
    up = edges.join(s.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min_by("src", F.struct(-F.col("up_sum"), "src")).alias("up_next"))
    down = edges.join(s.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min_by("dst", F.struct(-F.col("down_sum"), "dst")).alias("down_next"))
    return s.select("node").join(up, "node", "left").join(down, "node", "left")


def chain(edges: list[tuple], sums: dict, start, upward: bool) -> list:
    """Greedy walk from start over the best sum of unvisited neighbours, the first of equals."""
    near: dict = {}
    for a, b in sorted(set(edges)):
        near.setdefault(b if upward else a, []).append(a if upward else b)
    out, seen = [], {start}
    while True:
        open_ = [n for n in near.get(start, []) if n not in seen]
        if not open_:
            return out
        start = max(open_, key=lambda n: sums[n])
        seen.add(start)
        out.append(start)
