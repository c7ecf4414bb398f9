"""Strongly connected components by trimming and forward-backward colouring."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from modweave.runtime import cut


def _trim(edges: DataFrame, rounds: int = 2) -> DataFrame:
    """Edges whose source has an incoming and whose target an outgoing edge."""
    for _ in range(rounds):
        edges = edges.join(edges.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        edges = edges.join(edges.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
    return edges


def _trimmed(edges: DataFrame) -> tuple[DataFrame, int]:
    edges = cut(edges)
    before, n = -1, edges.count()
    while n and n != before and (before < 0 or n > LOCAL_EDGES):
        before, edges = n, cut(_trim(edges))
        n = edges.count()
    return edges, n


def _least_ancestor(edges: DataFrame) -> DataFrame:
    """(node, color): the least node from which a node is reachable, itself included."""
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    colors = cut(nodes.select("node", F.col("node").alias("color")))
    while True:
        def pushed(c):
            down = edges.join(c, edges["src"] == c["node"]).select(F.col("dst").alias("node"), "color")
            return c.unionByName(down).groupBy("node").agg(F.min("color").alias("color"))

        after = cut(pushed(pushed(colors)))
        moved = after.join(colors, ["node", "color"], "left_anti").isEmpty()
        colors = after
        if moved:
            return colors


#: A trimmed graph of up to so many edges is solved in one task; larger ones by colouring.
LOCAL_EDGES = 500_000


def tarjan(edges: list[tuple]) -> dict:
    """node -> least member of its component; without recursion."""
    after: dict = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index: dict = {}
    low: dict = {}
    root, path, on_path = {}, [], set()
    for start in after:
        if start in index:
            continue
        work = [(start, iter(after[start]))]
        index[start] = low[start] = len(index)
        path.append(start)
        on_path.add(start)
        while work:
            node, children = work[-1]
            child = next(children, None)
            if child is None:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = [path.pop()]
                    while members[-1] != node:
                        members.append(path.pop())
                    on_path.difference_update(members)
                    root.update(dict.fromkeys(members, min(members)))
            elif child not in index:
                index[child] = low[child] = len(index)
                path.append(child)
                on_path.add(child)
                work.append((child, iter(after[child])))
            elif child in on_path:
                low[node] = min(low[node], index[child])
    return root


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, scc_id) of the components of two or more of a graph of checked size."""
    import pandas as pd

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        root = tarjan(list(zip(frame["src"], frame["dst"], strict=True)))
        size: dict = {}
        for r in root.values():
            size[r] = size.get(r, 0) + 1
        nodes = [n for n, r in root.items() if size[r] > 1]
        return pd.DataFrame({"node": nodes, "scc_id": [root[n] for n in nodes]})

    kind = edges.schema["src"].dataType.simpleString()
    return edges.groupBy().applyInPandas(solve, f"node {kind}, scc_id {kind}")


def cyclic_components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, scc_id) of the nodes in components of two or more; scc_id is the least member.

    Nodes outside cycles are trimmed away first. In the rest every node takes the least node that
    reaches it as its colour, and a colour's root then searches backwards inside its colour: what
    it finds is one component. What remains is trimmed and coloured again, and as soon as it has at
    most ``local_edges`` edges one task finishes it.
    """
    rest, n = _trimmed(edges.select("src", "dst").filter("src <> dst").distinct())
    done: list[DataFrame] = []
    while n:
        if n <= local_edges:
            done.append(_in_one_task(rest))
            break
        colors = _least_ancestor(rest)
        a = colors.select(F.col("node").alias("src"), F.col("color").alias("sc"))
        b = colors.select(F.col("node").alias("dst"), F.col("color").alias("dc"))
        inside = cut(rest.join(a, "src").join(b, "dst").filter("sc = dc").select("src", "dst", F.col("sc").alias("color")))
        found = cut(colors.filter("node = color").select("node", "color"))
        newest = found
        while not newest.isEmpty():
            back = inside.join(newest.select(F.col("node").alias("dst"), "color"), ["dst", "color"], "left_semi").select(F.col("src").alias("node"), "color").distinct()
            newest = cut(back.join(found, "node", "left_anti"))
            found = found.unionByName(newest)
        found = cut(found.select("node", F.col("color").alias("scc_id")))
        sizes = found.groupBy("scc_id").count().filter("count > 1").select("scc_id")
        done.append(found.join(sizes, "scc_id", "left_semi").select("node", "scc_id"))
        gone = found.select("node")
        rest, n = _trimmed(rest.join(gone.select(F.col("node").alias("src")), "src", "left_anti").join(gone.select(F.col("node").alias("dst")), "dst", "left_anti"))
    if not done:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("scc_id")).limit(0)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, scc_id) of every node, single ones included; ``nodes`` (node) adds isolated ones."""
    every = edges.select(F.col("src").alias("node")).union(edges.select("dst"))
    every = (every.union(nodes.select("node")) if nodes is not None else every).distinct()
    return every.join(cyclic_components(edges), "node", "left").select("node", F.coalesce("scc_id", "node").alias("scc_id"))


def cycles(edges: DataFrame) -> DataFrame:
    """(scc_id, node, size) of the components of two or more; an import of itself is no cycle."""
    found = cut(cyclic_components(edges))
    return found.join(found.groupBy("scc_id").agg(F.count("*").alias("size")), "scc_id").select("scc_id", "node", "size")


def has_cycle(edges: DataFrame) -> bool:
    """Whether any cycle exists, imports of itself included."""
    return not edges.filter("src = dst").isEmpty() or not cyclic_components(edges).isEmpty()
