"""Condensed graphs, depth, layers, leaves, distances, partitions and path counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from modweave.operators.components import connected_components
from modweave.operators.reach import hop_distance
from modweave.operators.scc import cyclic_components
from modweave.runtime import cut


class GraphError(ValueError):
    """A graph or a list of components breaks a rule."""


def condense(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """Distinct (src_scc, dst_scc) between components; scc is (node, scc_id)."""
    a = scc.select(F.col("node").alias("src"), F.col("scc_id").alias("src_scc"))
    b = scc.select(F.col("node").alias("dst"), F.col("scc_id").alias("dst_scc"))
    return edges.join(a, "src").join(b, "dst").filter("src_scc <> dst_scc").select("src_scc", "dst_scc").distinct()


def check_components(edges: DataFrame, scc: DataFrame, nodes: DataFrame | None = None) -> None:
    """Raise if a node has no component, has several, or is not a node of the graph."""
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    every = (every.union(nodes.select("node")) if nodes is not None else every).distinct()
    for what, rows in (
        ("in no component", every.join(scc, "node", "left_anti")),
        ("not in the graph", scc.join(every, "node", "left_anti")),
        ("in several components", scc.groupBy("node").count().filter("count > 1")),
    ):
        bad = rows.select("node").first()
        if bad:
            raise GraphError(f"node {bad[0]!r} is {what}")


def leaves(dag: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes (scc_id) without an outgoing edge."""
    return nodes.select("scc_id").distinct().join(dag.select(F.col("src_scc").alias("scc_id")), "scc_id", "left_anti")


def depths(dag: DataFrame, nodes: DataFrame) -> DataFrame:
    """(scc_id, depth): the fewest edges to any leaf. Raises if a node lies on a cycle, as components never do."""
    wrong = cyclic_components(dag.select(F.col("src_scc").alias("src"), F.col("dst_scc").alias("dst"))).select("node").first()
    if wrong or not dag.filter("src_scc = dst_scc").isEmpty():
        raise GraphError(f"not acyclic: a cycle holds {wrong[0] if wrong else 'only itself'!r}")
    back = dag.select(F.col("dst_scc").alias("src"), F.col("src_scc").alias("dst"))
    found = hop_distance(back, leaves(dag, nodes).select(F.col("scc_id").alias("node")))
    return found.select(F.col("node").alias("scc_id"), F.col("hops").alias("depth"))


def reverse(dag: DataFrame) -> DataFrame:
    return dag.select(F.col("dst_scc").alias("src_scc"), F.col("src_scc").alias("dst_scc"))


def undirected(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, distinct."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def depth01(dag: DataFrame, depth: DataFrame) -> DataFrame:
    """Edges from components of depth 1 to those of depth 0."""
    one = depth.filter("depth = 1").select(F.col("scc_id").alias("src_scc"))
    zero = depth.filter("depth = 0").select(F.col("scc_id").alias("dst_scc"))
    return dag.join(one, "src_scc", "left_semi").join(zero, "dst_scc", "left_semi").select("src_scc", "dst_scc")


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected view; component is the least node."""
    return connected_components(edges)


def leaf_distances(edges: DataFrame, leaf_nodes: DataFrame) -> DataFrame:
    """(a, b, hops) for all pairs of leaves (node): undirected hops, null if unconnected, 0 to itself.

    One search runs for all leaves together, with the leaf as a second key.
    """
    both = cut(undirected(edges))
    seen = cut(leaf_nodes.select(F.col("node").alias("a"), "node").distinct().withColumn("hops", F.lit(0)))
    k = 0
    while True:
        newest = seen.filter(F.col("hops") == k).select("a", F.col("node").alias("src"))
        fresh = cut(both.join(newest, "src").select("a", F.col("dst").alias("node")).distinct().join(seen, ["a", "node"], "left_anti").withColumn("hops", F.lit(k + 1)))
        if fresh.isEmpty():
            break
        seen, k = seen.unionByName(fresh), k + 1
    a = leaf_nodes.select(F.col("node").alias("a")).distinct()
    b = leaf_nodes.select(F.col("node").alias("b")).distinct()
    pairs = a.join(b, F.lit(True))  # as many as the result: a stated matrix of few leaves
    return pairs.join(seen.withColumnRenamed("node", "b"), ["a", "b"], "left").select("a", "b", "hops")


#: Up to so many leaves all partitions are tried.
EXACT_LEAVES = 20


def leaf_partition(distances: DataFrame) -> DataFrame:
    """(leaf, side): two sides, A and B, whose cross distances have the largest sum; neither is empty.

    Under two leaves all are in A. Up to 20, all partitions with the first leaf in A compete, as
    rows of a range; ties go to the lexicographically least string of 1 (A) and 0 (B). Beyond, the
    first leaf is in A, the farthest from it in B, and the others are taken in order, each to the
    side that adds more (ties: A), where leaves that are not taken yet count as B.
    """
    spark = distances.sparkSession
    rows = distances.filter("a < b").select("a", "b", F.coalesce("hops", F.lit(0)).alias("d")).collect()
    names = sorted({r["a"] for r in distances.filter("a = b").select("a").collect()})
    n, at = len(names), {x: i for i, x in enumerate(names)}
    if n < 2:
        return distances.select(F.col("a").alias("leaf"), F.lit("A").alias("side"))
    far = {(at[r["a"]], at[r["b"]]): r["d"] for r in rows}
    if n <= EXACT_LEAVES:
        # bit n-1-i of the mask says that leaf i is in A, so the least mask is the least string; with all bits, B would be empty
        masks = spark.range(2 ** (n - 1) - 1).withColumnRenamed("id", "mask")
        bit = lambda i: F.shiftright("mask", n - 1 - i).bitwiseAND(1) if i else F.lit(1)
        total = sum((F.when(bit(i) != bit(j), d).otherwise(0) for (i, j), d in far.items() if d), F.lit(0))
        mask = masks.select("mask", total.alias("total")).agg(F.max_by("mask", F.struct("total", -F.col("mask")))).first()[0]
        sides = ["A" if not i or mask >> (n - 1 - i) & 1 else "B" for i in range(n)]
    else:
        sides = greedy_sides(n, lambda i, j: far.get((min(i, j), max(i, j)), 0))
    return spark.createDataFrame(list(zip(names, sides, strict=True)), f"leaf {distances.schema['a'].dataType.simpleString()}, side string")


def greedy_sides(n: int, distance) -> list[str]:
    """Sides of leaves 0 to n-1, beyond :data:`EXACT_LEAVES`."""
    seed = max(range(1, n), key=lambda j: (distance(0, j), -j))
    sides = ["A"] + ["B"] * (n - 1)
    for i in range(1, n):
        if i != seed:
            to_a, to_b = (sum(distance(i, j) for j in range(n) if j != i and sides[j] == s) for s in "AB")
            sides[i] = "A" if to_b >= to_a else "B"
    return sides


def levels(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, level), left): rounds in which Kahn's algorithm frees the nodes, dependents first.

    A node's level is the round after its last importer's. ``left`` (node) are those on or below
    a cycle, imports of itself included.
    """
    rest = cut(edges.select("src", "dst").distinct())
    waiting = cut(nodes.select("node").distinct())
    out, k = None, 0
    while True:
        free = cut(waiting.join(rest.select(F.col("dst").alias("node")), "node", "left_anti"))
        if free.isEmpty():
            break
        level = free.withColumn("level", F.lit(k))
        out = level if out is None else out.unionByName(level)
        waiting = cut(waiting.join(free, "node", "left_anti"))
        rest = cut(rest.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
        k += 1
    return (out if out is not None else nodes.select("node", F.lit(0).alias("level")).limit(0)), waiting


def toposort(edges: list[tuple[str, str]], nodes: list[str], reverse: bool = False) -> list[str] | None:
    """The exact order, dependents first, the least ready node next; None if a cycle is left."""
    import heapq

    waiting = dict.fromkeys(sorted(set(nodes)), 0)
    after: dict[str, list[str]] = {}
    for a, b in set(edges):
        waiting[b] += 1
        after.setdefault(a, []).append(b)
    ready = [n for n, k in waiting.items() if not k]
    out = []
    while ready:
        node = heapq.heappop(ready)
        out.append(node)
        for b in after.get(node, []):
            waiting[b] -= 1
            if not waiting[b]:
                heapq.heappush(ready, b)
    if len(out) < len(waiting):
        return None
    return out[::-1] if reverse else out


def path_counts(weighted: DataFrame, target) -> DataFrame:
    """(node, paths): ways from a node to the target, a way for each imported name of an edge.

    ``weighted`` is (src, dst, names) and must be acyclic above the target, else an error is raised.
    Sums run backwards, length by length; a decimal holds them.
    """
    back = cut(weighted.select("src", "dst", F.col("names").cast("decimal(38,0)").alias("names")).repartition("dst"))
    front = cut(back.sparkSession.createDataFrame([(target,)], f"node {weighted.schema['dst'].dataType.simpleString()}").withColumn("paths", F.lit(1).cast("decimal(38,0)")))
    total, left = front, None
    while True:
        front = cut(back.join(front, back["dst"] == front["node"]).groupBy("src").agg(F.sum((F.col("names") * F.col("paths")).cast("decimal(38,0)")).cast("decimal(38,0)").alias("paths")).select(F.col("src").alias("node"), "paths"))
        if front.isEmpty():
            break
        left = back.select("src").distinct().count() if left is None else left - 1  # a way visits each importer once
        if left <= 0:
            raise GraphError("ways cannot be counted: there is a cycle above the target")
        total = total.unionByName(front)
    return total.groupBy("node").agg(F.sum("paths").cast("decimal(38,0)").alias("paths"))


def import_chain(edges: list[tuple], start, target) -> list:
    """From start to target, always to the child with the fewest ways on, the first of equals; only the start if there is no way.

    ``edges`` are (src, dst, names). Ways are counted depth first, children ascending, a way for each
    imported name; a module whose own count is not complete, as one is inside a cycle, has no way
    from there.
    """
    if start == target:
        raise GraphError(f"{start!r} cannot import itself")
    after: dict = {}
    for a, b, names in sorted(edges):
        after.setdefault(a, []).append((b, names))
    ways, onward, stack = {target: 1}, {target: []}, [(start, iter(after.get(start, [])))]
    onward[start] = []
    while stack:
        node, children = stack[-1]
        child = next((c for c, _ in children if c not in onward), None)
        if child is not None:
            onward[child] = []
            stack.append((child, iter(after.get(child, []))))
            continue
        stack.pop()
        done = [(c, n) for c, n in after.get(node, []) if c in ways and ways[c]]
        onward[node] = [c for c, _ in done]
        ways[node] = sum(n * ways[c] for c, n in done)
    out = [start]
    while onward[out[-1]]:
        out.append(min(onward[out[-1]], key=lambda c: ways[c]))
    return out


def render_tree(edges: list[tuple[str, str]], roots: list[str]) -> str:
    """Nested list: ``.`` for a leaf, ``:`` for a node with children, ``...`` for one listed before."""
    after: dict[str, list[str]] = {}
    for a, b in sorted(set(edges)):
        after.setdefault(a, []).append(b)
    seen, lines = set(), []
    stack = [(r, 0) for r in reversed(roots)]
    while stack:
        node, level = stack.pop()
        kids = after.get(node, [])
        mark = "." if not kids else "..." if node in seen else ":"
        lines.append(f"{'  ' * level}{node}{mark}")
        if kids and node not in seen:
            stack.extend((k, level + 1) for k in reversed(kids))
        seen.add(node)
    return "\n".join(lines)
