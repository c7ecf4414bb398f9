"""Reachability over edge lists (src imports dst) by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from modweave.runtime import cut


def hop_distance(edges: DataFrame, sources: DataFrame, limit: int | None = None) -> DataFrame:
    """(node, hops) of every node reachable from ``sources`` (node), which have 0.

    Semi-naive: every round joins only the newest nodes with the edges, and keeps those not seen
    before. ``limit`` bounds the hops.
    """
    e = cut(edges.select("src", "dst").repartition("src").distinct())
    seen = cut(sources.select("node").filter("node IS NOT NULL").distinct().withColumn("hops", F.lit(0)))
    k, grown = 0, not seen.isEmpty()
    while grown and (limit is None or k < limit):
        k += 1
        newest = seen.filter(F.col("hops") == k - 1).select(F.col("node").alias("src"))
        found = e.join(newest, "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")
        fresh = cut(found.withColumn("hops", F.lit(k)))
        grown = not fresh.isEmpty()
        seen = seen.unionByName(fresh)
        if k % 8 == 0:
            seen = cut(seen)
    return seen


def dependencies(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(node): everything the sources depend on, themselves included."""
    return hop_distance(edges, sources).select("node")


def dependents(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(node): everything that depends on the targets, themselves included."""
    return dependencies(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), targets)


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path of at least one edge, by squaring; for small graphs, as the result may be quadratic."""
    paths = cut(edges.select("src", "dst").distinct())
    size = paths.count()
    while True:
        longer = paths.alias("a").join(paths.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        paths = cut(paths.unionByName(longer).distinct())
        grown = paths.count()
        if grown == size:
            return paths
        size = grown


def needing(edges: DataFrame, needs: DataFrame) -> DataFrame:
    """(node): modules that need a runtime, directly or through what they import.

    ``needs`` has node and nodejs. One backward search from all modules with the need.
    """
    return dependents(edges, needs.filter("nodejs").select("node"))


def leaf_users(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates (node) that do not transitively import any candidate, themselves included.

    A candidate fails if one of its imports reaches a candidate; so the question is asked of all
    nodes at once, backwards from the candidates.
    """
    c = candidates.select("node").distinct()
    reaching = dependents(edges, c)
    failing = edges.join(reaching.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
    return c.join(failing, "node", "left_anti")


def post_order(edges: list[tuple[str, str]], starts: list[str]) -> list[str]:
    """Depth-first order with dependencies first, for a reachable part that is small enough to print.

    Children in ascending order; a node is listed once, after all it reaches first.
    """
    after: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        after.setdefault(a, []).append(b)
    seen, out = set(), []
    for start in starts:
        stack = [(start, iter(after.get(start, [])))] if start not in seen else []
        seen.add(start)
        while stack:
            node, children = stack[-1]
            child = next((c for c in children if c not in seen), None)
            if child is None:
                out.append(node)
                stack.pop()
            else:
                seen.add(child)
                stack.append((child, iter(after.get(child, []))))
    return out


def path_to_need(edges: list[tuple[str, str]], start: str, needing: set[str]) -> list[str] | None:
    """First depth-first path (ascending children, each node visited once) from start to a module with the need."""
    after: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        after.setdefault(a, []).append(b)
    seen, stack = {start}, [(start, iter(after.get(start, [])))]
    if start in needing:
        return [start]
    while stack:
        child = next((c for c in stack[-1][1] if c not in seen), None)
        if child is None:
            stack.pop()
            continue
        seen.add(child)
        stack.append((child, iter(after.get(child, []))))
        if child in needing:
            return [n for n, _ in stack]
    return None
