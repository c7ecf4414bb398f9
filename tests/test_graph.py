import random

import pytest
from pyspark.sql import functions as F

from modweave.operators import dag, hot, reach, scc
from modweave.operators.components import connected_components
from modweave.operators.coupling import analyse, partition


def pairs(df):
    return {tuple(r) for r in df.collect()}


def brute_components(edges):
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        after.setdefault(b, set())

    def reached(n):
        seen, stack = set(), [n]
        while stack:
            for m in after[stack.pop()] - seen:
                seen.add(m)
                stack.append(m)
        return seen

    all_ = {n: reached(n) for n in after}
    return {n: min([n, *(m for m in all_[n] if n in all_[m])]) for n in after}


@pytest.mark.parametrize(("text", "groups"), [("a>b b>c", {"a": "a", "b": "b", "c": "c"}), ("a>b b>a", {"a": "a", "b": "a"}), ("a>b b>c c>a", {"a": "a", "b": "a", "c": "a"}), ("a>b a>c b>d c>d", {x: x for x in "abcd"}), ("a>b b>a b>c c>d", {"a": "a", "b": "a", "c": "c", "d": "d"})])
def test_components(edges, text, groups):
    assert dict(pairs(scc.components(edges(text)))) == groups


def test_a_self_import_is_no_cycle_of_modules_but_stops_the_order(edges):
    assert pairs(scc.cycles(edges("a>a"))) == set()
    assert dag.toposort([("a", "a")], ["a"]) is None
    assert scc.has_cycle(edges("a>a"))
    assert not scc.has_cycle(edges("a>b"))


@pytest.mark.parametrize("local", [0, 1000])
def test_components_of_random_graphs(spark, local):
    random.seed(5)
    e = {(random.randrange(60), random.randrange(60)) for _ in range(90)}
    df = spark.createDataFrame(sorted(e), "src long, dst long")
    want = {n: r for n, r in brute_components([x for x in e if x[0] != x[1]]).items()}
    sizes = {}
    for r in want.values():
        sizes[r] = sizes.get(r, 0) + 1
    assert dict(pairs(scc.cyclic_components(df, local))) == {n: r for n, r in want.items() if sizes[r] > 1}


def test_condensed_depth_is_the_shortest_way_to_a_leaf(edges):
    for text, depths in [("a>b b>c", {"a": 2, "b": 1, "c": 0}), ("a>b a>c b>d c>d", {"a": 2, "b": 1, "c": 1, "d": 0}), ("a>b b>a b>c c>d", {"a": 2, "c": 1, "d": 0}), ("a>b b>c c>d a>d", {"a": 1, "b": 2, "c": 1, "d": 0}), ("a>b b>a", {"a": 0})]:
        e = edges(text)
        found = scc.components(e)
        dag.check_components(e, found)
        assert dict(pairs(dag.depths(dag.condense(e, found), found.select("scc_id").distinct()))) == depths


def test_wrong_components_are_refused(spark, edges):
    e = edges("a>b")
    for rows in ([("a", "a")], [("a", "a"), ("b", "b"), ("c", "c")], [("a", "a"), ("b", "b"), ("b", "a")]):
        with pytest.raises(dag.GraphError):
            dag.check_components(e, spark.createDataFrame(rows, "node string, scc_id string"))


def test_leaf_distances_and_partition(spark):
    tree = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 4)], "src long, dst long")
    leaves = spark.createDataFrame([(3,), (4,)], "node long")
    d = dag.leaf_distances(tree, leaves)
    assert pairs(d) == {(3, 3, 0), (4, 4, 0), (3, 4, 4), (4, 3, 4)}
    assert dict(pairs(dag.leaf_partition(d))) == {3: "A", 4: "B"}
    apart = spark.createDataFrame([(0, 1), (2, 3)], "src long, dst long")
    assert (1, 3, None) in pairs(dag.leaf_distances(apart, spark.createDataFrame([(1,), (3,)], "node long")))
    one = dag.leaf_distances(spark.createDataFrame([(0, 1)], "src long, dst long"), spark.createDataFrame([(1,)], "node long"))
    assert dict(pairs(dag.leaf_partition(one))) == {1: "A"}


@pytest.mark.parametrize(("names", "hops", "first"), [("abc", 2, "a"), ("abc", None, "a"), ("abcd", 2, "ad"), ("ab", None, "a")])
def test_partition_ties_go_to_the_least_string(spark, names, hops, first):
    rows = [(a, b, 0 if a == b else hops) for a in names for b in names]
    sides = dict(pairs(dag.leaf_partition(spark.createDataFrame(rows, "a string, b string, hops int"))))
    assert sides == {n: "A" if n in first else "B" for n in names}
    assert partition(list(names), {(a, b): h or 0 for a, b, h in rows}) == ([n for n in names if n in first], [n for n in names if n not in first])


def test_greedy_sides_follow_the_rule():
    random.seed(4)
    far = {(i, j): random.randrange(6) for i in range(23) for j in range(i + 1, 23)}
    d = lambda i, j: far[min(i, j), max(i, j)]
    got = dag.greedy_sides(23, d)
    score = lambda sides: sum(k for (i, j), k in far.items() if sides[i] != sides[j])
    seed = max(range(1, 23), key=lambda j: (d(0, j), -j))
    want = ["A"] + ["B"] * 22
    for i in range(1, 23):
        if i != seed:
            want = max([want[:i] + ["A"] + want[i + 1 :], want[:i] + ["B"] + want[i + 1 :]], key=score)
    assert got == want


def test_depths_refuse_cycles(spark):
    dag_ = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (3, 4)], "src_scc long, dst_scc long")
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "scc_id long")
    with pytest.raises(dag.GraphError):
        dag.depths(dag_, nodes)
    with pytest.raises(dag.GraphError):
        dag.depths(spark.createDataFrame([(1, 1)], "src_scc long, dst_scc long"), nodes)


def test_deep_trees_are_listed_whole():
    n = 120
    lines = dag.render_tree([(f"n{i:03}", f"n{i + 1:03}") for i in range(n)], ["n000"]).split("\n")
    assert [x.strip() for x in lines] == [f"n{i:03}:" for i in range(n)] + [f"n{n:03}."]


def test_spread_is_exact(monkeypatch, spark):
    random.seed(6)
    monkeypatch.setattr(hot, "SORTED", 10)
    for values in ([random.random() for _ in range(3001)], [1.0] * 50 + [2.0] * 51, [5.0], [3.0, 1.0]):
        got = hot.spread(spark.createDataFrame([(v,) for v in values], "badness double")).first()
        assert tuple(got) == (min(values), sorted(values)[len(values) // 2], max(values))
    assert hot.spread(spark.createDataFrame([], "badness double")).count() == 0


def test_components_of_long_rings():
    ring = [(i, (i + 1) % 50000) for i in range(50000)]
    assert set(scc.tarjan(ring).values()) == {0}


def test_partition_beyond_the_exact_limit_is_greedy(spark):
    names = range(24)
    rows = [(a, b, 0 if a == b else 1 + (a + b) % 5) for a in names for b in names]
    sides = dict(pairs(dag.leaf_partition(spark.createDataFrame(rows, "a long, b long, hops int"))))
    assert sides[0] == "A"
    assert set(sides.values()) == {"A", "B"}


def test_orders():
    assert dag.toposort([("a", "b"), ("b", "c")], list("abc")) == ["a", "b", "c"]
    assert dag.toposort([], ["c", "a", "b"]) == ["a", "b", "c"]
    assert dag.toposort([("a", "b"), ("b", "c"), ("c", "b")], list("abcd")) is None
    assert dag.toposort([("a", "b")], ["a", "b"], reverse=True) == ["b", "a"]
    assert reach.post_order([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], ["a"]) == ["d", "b", "c", "a"]


def test_levels(edges, spark):
    nodes = spark.createDataFrame([(x,) for x in "abcde"], "node string")
    found, left = dag.levels(edges("a>b b>c d>e e>d"), nodes)
    assert dict(pairs(found)) == {"a": 0, "b": 1, "c": 2}
    assert pairs(left) == {("d",), ("e",)}


def test_path_counts_and_chain(spark):
    weighted = spark.createDataFrame([("a", "b", 1), ("a", "c", 2), ("b", "d", 1), ("c", "d", 1)], "src string, dst string, names long")
    counts = {r["node"]: int(r["paths"]) for r in dag.path_counts(weighted, "d").collect()}
    assert counts == {"d": 1, "b": 1, "c": 1, "a": 3}
    plain = [("a", "b", 2), ("a", "c", 1), ("b", "d", 2), ("b", "c", 1), ("c", "d", 1)]
    assert dag.import_chain(plain, "a", "d") == ["a", "c", "d"]
    assert dag.import_chain([(a, b, 1) for a, b, _ in plain], "a", "d") == ["a", "c", "d"]
    assert dag.import_chain([("a", "b", 1), ("a", "c", 1), ("b", "d", 1), ("c", "d", 1)], "a", "d") == ["a", "b", "d"]
    assert dag.import_chain(plain, "a", "x") == ["a"]
    with pytest.raises(dag.GraphError):
        dag.import_chain(plain, "a", "a")
    with pytest.raises(dag.GraphError, match="cycle"):
        dag.path_counts(spark.createDataFrame([("a", "b", 1), ("b", "a", 1), ("b", "t", 1)], "src string, dst string, names long"), "t")


def test_import_chain_inside_cycles():
    loop = [("a", "b", 1), ("b", "a", 1), ("b", "t", 1)]
    assert dag.import_chain(loop, "a", "b") == ["a", "b"]
    assert dag.import_chain(loop, "a", "t") == ["a", "b", "t"]
    assert dag.import_chain(loop, "b", "t") == ["b", "t"]
    # a opens b, which opens c; from c, a is open and has no way, so c goes by t alone
    assert dag.import_chain([("a", "b", 1), ("b", "c", 1), ("c", "a", 1), ("c", "t", 1), ("b", "t", 3)], "a", "t") == ["a", "b", "c", "t"]


def test_reachability(edges, spark):
    e = edges("a>b b>c c>a c>d x>d")
    start = spark.createDataFrame([("b",)], "node string")
    assert dict(pairs(reach.hop_distance(e, start))) == {"b": 0, "c": 1, "a": 2, "d": 2}
    assert pairs(reach.closure(edges("a>b b>c"))) == {("a", "b"), ("b", "c"), ("a", "c")}
    assert reach.path_to_need([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")], "a", {"d"}) == ["a", "b", "d"]
    assert reach.path_to_need([("a", "b")], "a", {"z"}) is None
    users = spark.createDataFrame([("a",), ("d",), ("x",)], "node string")
    assert pairs(reach.leaf_users(e, users)) == {("d",)}


def test_connected_components_of_random_graphs(spark):
    random.seed(3)
    e = [(random.randrange(200), random.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1060)]
    label = {x: x for p in e for x in p}
    for _ in range(100):
        for a, b in e:
            label[a] = label[b] = min(label[a], label[b])
    got = dict(pairs(connected_components(spark.createDataFrame(e, "src long, dst long"))))
    alone = {a for a, b in e if a == b and sum(a in p and p[0] != p[1] for p in e) == 0}
    assert got == {n: r for n, r in label.items() if n not in alone}


def test_hot_scores(edges):
    s = {r["node"]: r for r in hot.scores(edges("a>b b>c")).collect()}
    assert [round(s[n]["badness"], 6) for n in "abc"] == [0, 0.01, 0]
    assert [tuple(r) for r in hot.hottest(hot.scores(edges("a>b b>c")).withColumn("badness", F.col("badness") * 100)).collect()][0] == ("b", 1)
    assert hot.chain([("a", "b"), ("b", "c")], {"a": 1, "b": 2, "c": 3}, "a", False) == ["b", "c"]


def test_hot_scores_in_a_cycle_follow_the_canonical_walk(edges):
    s = {r["node"]: r for r in hot.scores(edges("a>b b>a c>a")).collect()}
    # down: a enters b, which meets a again (100, importers of a: 2) and so on
    assert round(s["b"]["down_weight"], 6) == 50.1
    assert round(s["a"]["down_weight"], 6) == 50.2
    assert round(s["c"]["down_weight"], 6) == 25.2


def test_coupling_analysis():
    members = ["root", "left", "right", "middle", "leaf"]
    a = analyse(members, {("root", "left"), ("root", "right"), ("left", "middle"), ("right", "middle"), ("middle", "leaf")})
    assert a.depth == {"root": 3, "left": 2, "right": 2, "middle": 1, "leaf": 0}
    assert a.groups == [["leaf", "middle"]]
    assert a.clusters == (["leaf"], [])
    c = analyse(["first", "second", "left", "right"], {("first", "second"), ("first", "left"), ("second", "first"), ("second", "right")})
    assert c.depth["first"] == 1
    assert c.label["first"] == "first, second"
    assert c.clusters == (["left"], ["right"])
