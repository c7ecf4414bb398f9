"""Registered queries over the derived module facts, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from modweave.functions import paths, text
from modweave.operators import dag, hot, lookups, reach, resolve, scc
from modweave.runtime import cut
from modweave.sources.fixtures import SCC_SQL, SQL, Facts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _path(key: int) -> str:
    return f"/repo/pkg{key % 6}/d{key % 40}/m{key}.ts"


def _config(key: int) -> str:
    return f"/repo/pkg{key % 6}/tsconfig.json"


def query(sql: str | None = None, head: str = SQL):
    """Register a function of facts under its name, with its SQL."""

    def add(f: Callable[[Facts], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Facts(spark, sf_dir))
        if sql is not None:
            ORACLES[f.__name__] = f"{head.rstrip()}\n{sql}" if head else sql
        return f

    return add


# Facts and access paths


@query("SELECT src, dst FROM edges")
def module_edges(f: Facts):
    return f.edges()


@query("""SELECT 'resolved' AS fact, count(*) AS n FROM imports WHERE exporter_path IS NOT NULL
UNION ALL SELECT 'unresolved', count(*) FROM imports WHERE exporter_path IS NULL
UNION ALL SELECT 'reexports', count(*) FROM reexports UNION ALL SELECT 'needs', count(*) FROM needs WHERE nodejs""")
def module_facts(f: Facts):
    kinds = f.imports().select(F.when(F.col("exporter_path").isNotNull(), "resolved").otherwise("unresolved").alias("fact"))
    return kinds.unionByName(f.reexports().select(F.lit("reexports").alias("fact"))).unionByName(f.needs().filter("nodejs").select(F.lit("needs").alias("fact"))).groupBy("fact").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT importer_path FROM imports WHERE exporter_path = '{_path(1)}'")
def importers_of(f: Facts):
    return lookups.importers_of(f.imports(), _path(1))


@query(f"SELECT importer_path FROM imports WHERE exporter_path = '{_path(5)}' AND symbol_name IN ('sym40', 'sym1')")
def importers_of_symbol(f: Facts):
    return lookups.importers_of_symbol(f.imports(), _path(5), "sym40").union(lookups.importers_of_symbol(f.imports(), _path(5), "sym1"))


@query(f"SELECT importer_path, exporter_path, symbol_name, exporter_spec FROM imports WHERE importer_path = '{_path(101)}'")
def imports_from(f: Facts):
    return lookups.imports_from(f.imports(), _path(101)).select("importer_path", "exporter_path", "symbol_name", "exporter_spec")


@query("SELECT path, symbol_name, module_spec FROM reexports WHERE symbol_name = 'sym3'")
def reexports_named(f: Facts):
    return lookups.reexports_named(f.reexports(), "sym3").select("path", "symbol_name", "module_spec")


@query(f"SELECT path, symbol_name, module_spec FROM reexports WHERE path = '{_path(3)}'")
def reexports_of(f: Facts):
    return lookups.reexports_of(f.reexports(), _path(3)).select("path", "symbol_name", "module_spec")


@query(f"SELECT exporter_path, exporter_tsconfig, symbol_name FROM imports WHERE importer_path = '{_path(150)}' AND exporter_path IS NOT NULL")
def exporters_of(f: Facts):
    return lookups.exporters_of(f.imports(), _path(150))


@query("SELECT importer_path, exporter_path, import_index FROM imports WHERE exporter_path IS NOT NULL AND symbol_name = 'sym7'")
def imports_of_symbol(f: Facts):
    return lookups.imports_of_symbol(f.imports(), "sym7").select("importer_path", "exporter_path", "import_index")


_USE = f"FROM imports WHERE importer_tsconfig = '{_config(1)}' AND exporter_tsconfig = '{_config(2)}'"


@query(f"SELECT exporter_path, array_to_string(list_sort(list(DISTINCT importer_path)), ',') AS importers {_USE} GROUP BY 1")
def project_use(f: Facts):
    return lookups.project_use(f.imports(), _config(1), _config(2)).withColumn("importers", F.array_join("importers", ","))


@query(f"SELECT exporter_path, symbol_name, array_to_string(list_sort(list(DISTINCT importer_path)), ',') AS importers {_USE} GROUP BY 1, 2")
def project_use_symbols(f: Facts):
    return lookups.project_use_symbols(f.imports(), _config(1), _config(2)).withColumn("importers", F.array_join("importers", ","))


@query(f"SELECT DISTINCT exporter_path, importer_path FROM imports WHERE exporter_tsconfig = '{_config(3)}' AND symbol_name = 'sym9'")
def symbol_usage(f: Facts):
    return lookups.symbol_usage(f.imports(), _config(3), "sym9")


@query("SELECT DISTINCT exporter_path, importer_path FROM imports WHERE starts_with(exporter_path, '/repo/pkg3/') AND symbol_name IN ('sym9', 'sym2')")
def symbol_usage_folder(f: Facts):
    return lookups.symbol_usage(f.imports(), "/repo/pkg3", "sym9").union(lookups.symbol_usage(f.imports(), "/repo/pkg3", "sym2")).distinct()


@query(f"SELECT exporter_path, array_to_string(list_sort(list(DISTINCT symbol_name)), ',') AS symbols FROM imports WHERE importer_path = '{_path(101)}' AND exporter_path IS NOT NULL AND NOT starts_with(exporter_path, '/repo/pkg9/') GROUP BY 1")
def trace_file(f: Facts):
    return lookups.trace_imports(f.imports(), _path(101)).withColumn("symbols", F.array_join("symbols", ","))


@query(f"SELECT exporter_path, array_to_string(list_sort(list(DISTINCT symbol_name)), ',') AS symbols FROM imports WHERE starts_with(importer_path, '/repo/pkg2/') AND starts_with(exporter_path, '/repo/pkg4/') GROUP BY 1")
def trace_from_project(f: Facts):
    return lookups.trace_imports(f.imports(), "/repo/pkg2", _config(4)).withColumn("symbols", F.array_join("symbols", ","))


@query("SELECT DISTINCT importer_path AS path FROM imports WHERE symbol_name IN ('sym1', 'sym2') AND starts_with(importer_path, '/repo/pkg2/') AND importer_path NOT IN (SELECT exporter_path FROM imports WHERE symbol_name IN ('sym1', 'sym2') AND starts_with(importer_path, '/repo/pkg2/') AND exporter_path IS NOT NULL)")
def type_users_in_folder(f: Facts):
    return lookups.users_of_types(f.imports(), ["sym1", "sym2"], folder="/repo/pkg2")


@query("""SELECT i.importer_path, i.exporter_path AS via, i.symbol_name, m.path AS original_path FROM imports i JOIN reexports r ON r.path = i.exporter_path AND r.symbol_name = i.symbol_name
JOIN modules m ON m.key = CAST(substr(r.module_spec, 4) AS BIGINT) WHERE EXISTS (SELECT 1 FROM reexports x WHERE x.path = m.path AND x.symbol_name = i.symbol_name)""")
def import_directly_originals(f: Facts):
    found = lookups.direct_candidates(f.imports(), f.reexports()).withColumn("key", F.expr("cast(substring(module_spec, 4) as bigint)"))
    known = found.join(f.modules().select("key", F.col("path").alias("original_path")), "key")
    return lookups.exporting(known, f.reexports()).select("importer_path", "via", "symbol_name", "original_path")


@query("SELECT path, CASE WHEN key % 6 = 2 AND key % 40 = 8 THEN '@near/m' || key WHEN key % 6 = 2 THEN '@two/d' || (key % 40) || '/m' || key END AS spec FROM modules")
def aliased_specifiers(f: Facts):
    configs = f.spark.createDataFrame([(_config(2), {"@near/*": ["d8/*"], "@two/*": ["./*"]})], "path string, paths map<string,array<string>>").withColumn("base_url", F.lit(None).cast("string")).withColumn("root_dir", F.lit(None).cast("string"))
    return resolve.specifier_of(f.modules().select("path", "tsconfig"), configs).select("path", "spec")


@query("SELECT DISTINCT exporter_path FROM imports WHERE symbol_name = 'sym11' AND starts_with(exporter_path, '/repo/pkg1/')")
def grep_defs(f: Facts):
    return lookups.definitions(f.imports(), "/repo/pkg1", "sym11")


@query("SELECT exporter_path, array_to_string(list_sort(list(DISTINCT importer_path)), ',') AS importers, count(DISTINCT importer_path) AS n FROM imports WHERE symbol_name = 'sym11' AND starts_with(exporter_path, '/repo/pkg1/') GROUP BY 1")
def grep_uses(f: Facts):
    return lookups.uses(f.imports(), "/repo/pkg1", "sym11").withColumn("importers", F.array_join("importers", ","))


@query("SELECT exporter_path, array_to_string(list_sort(list(DISTINCT symbol_name)), ',') AS symbols FROM imports WHERE starts_with(importer_path, '/repo/pkg2/') AND exporter_path IS NOT NULL GROUP BY 1")
def trace_imports(f: Facts):
    return lookups.trace_imports(f.imports(), "/repo/pkg2").withColumn("symbols", F.array_join("symbols", ","))


@query("SELECT count(DISTINCT exporter_path) AS exporters, count(DISTINCT exporter_path || '|' || symbol_name) AS symbols FROM imports WHERE starts_with(importer_path, '/repo/pkg2/') AND exporter_path IS NOT NULL")
def trace_imports_total(f: Facts):
    return lookups.trace_total(f.imports(), "/repo/pkg2")


@query("SELECT node, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT src AS node, 0 AS i, 1 AS o FROM edges UNION ALL SELECT dst, 1, 0 FROM edges) GROUP BY 1")
def fan_in_out(f: Facts):
    return lookups.fan_in_out(f.edges())


@query("SELECT exporter_spec, count(DISTINCT importer_path) AS importers, count(*) AS uses FROM imports WHERE exporter_path IS NULL GROUP BY 1")
def unresolved_specs(f: Facts):
    return lookups.unresolved(f.imports())


@query(f"SELECT DISTINCT importer_path AS src, exporter_path AS dst FROM imports WHERE importer_tsconfig = '{_config(1)}' AND exporter_tsconfig = '{_config(1)}'")
def same_project_edges(f: Facts):
    return lookups.same_project(f.imports(), _config(1))


@query("SELECT DISTINCT importer_path AS src, exporter_path AS dst FROM imports WHERE starts_with(importer_path, '/repo/pkg1/') AND starts_with(exporter_path, '/repo/pkg1/')")
def scoped_edges(f: Facts):
    return lookups.module_graph(f.imports(), f.modules().filter(lookups.within("path", "/repo/pkg1")))


_DIRS = "SELECT DISTINCT regexp_extract(importer_path, '^(.*)/[^/]*$', 1) AS src, regexp_extract(exporter_path, '^(.*)/[^/]*$', 1) AS dst FROM imports WHERE exporter_path IS NOT NULL"


@query(f"SELECT src, dst FROM ({_DIRS}) WHERE src <> dst")
def directory_edges(f: Facts):
    return lookups.directory_graph(lookups.module_graph(f.imports()))


# Joins and sets


@query("SELECT i.importer_path, i.exporter_path AS via, i.symbol_name, r.module_spec, r.is_type_only FROM imports i JOIN reexports r ON r.path = i.exporter_path AND r.symbol_name = i.symbol_name")
def import_directly_candidates(f: Facts):
    return lookups.direct_candidates(f.imports(), f.reexports())


@query("""SELECT path, symbol_name FROM reexports r WHERE NOT EXISTS (SELECT 1 FROM imports i WHERE i.exporter_path = r.path AND i.symbol_name = r.symbol_name)
AND NOT EXISTS (SELECT 1 FROM imports i WHERE i.exporter_path = r.path AND i.symbol_name = '*')""")
def unused_reexports(f: Facts):
    return lookups.unused_reexports(f.imports(), f.reexports()).select("path", "symbol_name")


@query("""SELECT path, count(*) AS skipped FROM reexports r WHERE NOT EXISTS (SELECT 1 FROM imports i WHERE i.exporter_path = r.path AND i.symbol_name = r.symbol_name)
AND EXISTS (SELECT 1 FROM imports i WHERE i.exporter_path = r.path AND i.symbol_name = '*') GROUP BY 1""")
def skipped_namespace_reexports(f: Facts):
    return lookups.spared_by_namespace(f.imports(), f.reexports())


@query("SELECT path, symbol_name FROM reexports WHERE NOT public")
def public_filter(f: Facts):
    public = f.reexports().filter("public").select("path", "symbol_name")
    return f.reexports().join(public, ["path", "symbol_name"], "left_anti").select("path", "symbol_name")


@query("""SELECT path, count(*) AS total, count(*) FILTER (public) AS public, count(*) FILTER (NOT public AND NOT EXISTS (SELECT 1 FROM imports i WHERE i.exporter_path = r.path AND i.symbol_name = r.symbol_name)) AS unused FROM reexports r GROUP BY 1""")
def reexport_counts(f: Facts):
    return lookups.reexport_counts(f.imports(), f.reexports())


_USERS = "SELECT DISTINCT importer_path AS path FROM imports WHERE symbol_name IN ('sym5', 'sym6') AND exporter_path IS NOT NULL EXCEPT SELECT exporter_path FROM imports WHERE symbol_name IN ('sym5', 'sym6')"


@query(_USERS)
def type_users_minus_definers(f: Facts):
    return lookups.users_of_types(f.imports(), ["sym5", "sym6"])


@query("SELECT importer_path AS path, exporter_path AS import_name FROM imports WHERE symbol_name IN ('sym1', 'sym2') AND exporter_path IS NOT NULL EXCEPT SELECT importer_path, exporter_path FROM imports WHERE symbol_name NOT IN ('sym1', 'sym2')")
def only_used_by(f: Facts):
    uses = lookups.resolved(f.imports()).select(F.col("importer_path").alias("path"), "symbol_name", F.col("exporter_path").alias("import_name"))
    return lookups.only_used_by(uses, ["sym1", "sym2"])


# Reachability


def _nodes(f: Facts, *keys: int) -> DataFrame:
    return f.spark.createDataFrame([(k,) for k in keys], "node long")


@query("SELECT node FROM (WITH RECURSIVE r(node) AS (SELECT unnest([150, 151]) UNION SELECT e.dst FROM r JOIN edges e ON e.src = r.node) SELECT CAST(node AS BIGINT) AS node FROM r)")
def dependencies_of(f: Facts):
    return reach.dependencies(f.edges(), _nodes(f, 150, 151))


@query(f"SELECT path FROM (WITH RECURSIVE s AS (SELECT DISTINCT importer_path AS src, exporter_path AS dst FROM imports WHERE importer_tsconfig = '{_config(5)}' AND exporter_tsconfig = '{_config(5)}'), r(path) AS (SELECT '{_path(197)}' UNION SELECT s.dst FROM r JOIN s ON s.src = r.path) SELECT path FROM r)")
def dependencies_scoped(f: Facts):
    start = f.spark.createDataFrame([(_path(197),)], "node string")
    return reach.dependencies(lookups.same_project(f.imports(), _config(5)), start).withColumnRenamed("node", "path")


@query("SELECT node FROM (WITH RECURSIVE r(node) AS (SELECT key FROM modules WHERE size <= 2 UNION SELECT e.src FROM r JOIN edges e ON e.dst = r.node) SELECT node FROM r)")
def needs_runtime(f: Facts):
    return reach.needing(f.edges(), f.modules().select(F.col("key").alias("node"), (F.col("size") <= 2).alias("nodejs")))


@query("SELECT node, CAST(min(hops) AS INTEGER) AS hops FROM (WITH RECURSIVE r(node, hops) AS (SELECT CAST(150 AS BIGINT), 0 UNION SELECT e.dst, r.hops + 1 FROM r JOIN edges e ON e.src = r.node WHERE r.hops < 80) SELECT * FROM r) GROUP BY 1")
def hop_distance(f: Facts):
    return reach.hop_distance(f.edges(), _nodes(f, 150))


@query(f"""SELECT path FROM (WITH RECURSIVE c AS ({_USERS}),
p AS (SELECT DISTINCT importer_path AS src, exporter_path AS dst FROM imports WHERE exporter_path IS NOT NULL),
t(src, dst) AS (SELECT src, dst FROM p WHERE src IN (SELECT path FROM c) UNION SELECT t.src, p.dst FROM t JOIN p ON p.src = t.dst)
SELECT path FROM c WHERE path NOT IN (SELECT src FROM t WHERE dst IN (SELECT path FROM c)))""")
def type_leaf_usage(f: Facts):
    imports = f.imports()
    users = cut(lookups.users_of_types(imports, ["sym5", "sym6"]).select(F.col("path").alias("node")))
    return reach.leaf_users(lookups.module_graph(imports), users).select(F.col("node").alias("path"))


# Cycles and condensed graphs


@query("SELECT scc_id, node, count(*) OVER (PARTITION BY scc_id) AS size FROM scc QUALIFY size > 1", SCC_SQL)
def module_cycles(f: Facts):
    return scc.cycles(f.edges())


@query(f"""SELECT node, scc_id FROM (WITH RECURSIVE d AS (SELECT src, dst FROM ({_DIRS}) WHERE src <> dst),
c(src, dst) AS (SELECT src, dst FROM d UNION SELECT c.src, d.dst FROM c JOIN d ON c.dst = d.src)
SELECT x.src AS node, least(x.src, min(x.dst)) AS scc_id FROM c x JOIN c y ON x.src = y.dst AND x.dst = y.src WHERE x.src <> x.dst GROUP BY x.src)""")
def directory_cycles(f: Facts):
    return scc.cyclic_components(lookups.directory_graph(lookups.module_graph(f.imports())))


@query("SELECT node, scc_id FROM scc", SCC_SQL)
def scc_membership(f: Facts):
    return scc.components(f.edges())


def _condensed(f: Facts) -> tuple[DataFrame, DataFrame]:
    edges = cut(f.edges())
    found = cut(scc.components(edges))
    return cut(dag.condense(edges, found)), found.select("scc_id").distinct()


@query("SELECT src_scc, dst_scc FROM condensed", SCC_SQL)
def condensed_edges(f: Facts):
    return _condensed(f)[0]


@query("SELECT scc_id, CAST(depth AS INTEGER) AS depth FROM depths", SCC_SQL)
def min_depth(f: Facts):
    return dag.depths(*_condensed(f))


@query("SELECT scc_id FROM leaves", SCC_SQL)
def dag_leaves(f: Facts):
    return dag.leaves(*_condensed(f))


_SUBSET = "SELECT c.src_scc, c.dst_scc FROM condensed c JOIN depths a ON a.scc_id = c.src_scc AND a.depth = 1 JOIN depths b ON b.scc_id = c.dst_scc AND b.depth = 0"


@query(_SUBSET, SCC_SQL)
def depth01_subset(f: Facts):
    edges, nodes = _condensed(f)
    return dag.depth01(edges, dag.depths(edges, nodes))


@query(f"""SELECT node, component FROM (WITH RECURSIVE s AS ({_SUBSET}),
u AS (SELECT src_scc AS src, dst_scc AS dst FROM s UNION SELECT dst_scc, src_scc FROM s), w(node, other) AS (SELECT src, src FROM u UNION SELECT w.node, u.dst FROM w JOIN u ON u.src = w.other)
SELECT node, min(other) AS component FROM w GROUP BY 1)""", SCC_SQL)
def weak_components(f: Facts):
    edges, nodes = _condensed(f)
    subset = dag.depth01(edges, dag.depths(edges, nodes))
    return dag.weak_components(subset.select(F.col("src_scc").alias("src"), F.col("dst_scc").alias("dst")))


# Brands import the types that they have more often than a brand and type have on average: a small graph of a whole table.
_KIND_SQL = "p AS (SELECT p_brand AS src, p_type AS dst FROM part GROUP BY 1, 2 HAVING count(*) > (SELECT avg(k) FROM (SELECT count(*) AS k FROM part GROUP BY p_brand, p_type))), l AS (SELECT DISTINCT dst AS node FROM p)"
_HOPS = f"""WITH RECURSIVE {_KIND_SQL}, u AS (SELECT src, dst FROM p UNION SELECT dst, src FROM p),
w(a, b, hops) AS (SELECT node, node, 0 FROM l UNION SELECT w.a, u.dst, w.hops + 1 FROM w JOIN u ON u.src = w.b WHERE w.hops < 30),
m AS (SELECT a, b, min(hops) AS hops FROM w GROUP BY 1, 2)
SELECT x.node AS a, y.node AS b, CAST(m.hops AS INTEGER) AS hops FROM l x CROSS JOIN l y LEFT JOIN m ON m.a = x.node AND m.b = y.node"""


def _kinds(f: Facts) -> DataFrame:
    counted = f.table("part").groupBy(F.col("p_brand").alias("src"), F.col("p_type").alias("dst")).agg(F.count("*").alias("n"))
    edges = cut(counted.join(F.broadcast(counted.agg(F.avg("n").alias("mean"))), F.col("n") > F.col("mean")).select("src", "dst"))  # one row is broadcast
    return dag.leaf_distances(edges, edges.select(F.col("dst").alias("node")).distinct().join(edges.select(F.col("src").alias("node")), "node", "left_anti"))


@query(_HOPS, "")
def leaf_distance(f: Facts):
    return _kinds(f)


#: Bit n-1-k says that leaf k is in A, as the first is; the least string of bits wins a tie, and all ones would leave B empty.
_SIDES = """masks AS (SELECT mask + CAST(pow(2, n - 1) AS BIGINT) AS mask FROM (SELECT max(n) AS n, unnest(range(CAST(pow(2, max(n) - 1) AS BIGINT) - 1)) AS mask FROM i)),
best AS (SELECT mask, sum(CASE WHEN ((mask >> (n - 1 - i)) & 1) <> ((mask >> (n - 1 - j)) & 1) THEN h ELSE 0 END) AS total FROM masks, pairs GROUP BY 1 ORDER BY total DESC, mask LIMIT 1)
SELECT leaf, CASE WHEN ((mask >> (n - 1 - k)) & 1) = 1 THEN 'A' ELSE 'B' END AS side FROM i, best)"""


@query(f"""SELECT leaf, side FROM (WITH d AS ({_HOPS}), i AS (SELECT a AS leaf, row_number() OVER (ORDER BY a) - 1 AS k, count(*) OVER () AS n FROM d WHERE a = b),
pairs AS (SELECT x.k AS i, y.k AS j, x.n AS n, coalesce(hops, 0) AS h FROM d JOIN i x ON x.leaf = d.a JOIN i y ON y.leaf = d.b WHERE d.a < d.b),
{_SIDES}""", "")
def leaf_partition(f: Facts):
    return dag.leaf_partition(_kinds(f))


# Scores and orders


@query("""SELECT node, CAST(sum(w) AS BIGINT) AS paths FROM (WITH RECURSIVE e AS (SELECT a AS src, b AS dst, count(*) AS names FROM import_keys WHERE kind = 'cross' GROUP BY 1, 2),
p(node, w) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS HUGEINT) UNION ALL SELECT e.src, p.w * e.names FROM p JOIN e ON e.dst = p.node) SELECT * FROM p) GROUP BY 1""")
def import_path_counts(f: Facts):
    weighted = f.import_keys().filter("kind = 'cross'").groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("names"))
    return dag.path_counts(weighted, 1).select("node", F.col("paths").cast("long").alias("paths"))


@query("""SELECT node, CAST(max(level) AS INTEGER) AS level FROM (WITH RECURSIVE k(node, level) AS (SELECT DISTINCT src, 0 FROM dag WHERE src NOT IN (SELECT dst FROM dag) UNION SELECT d.dst, k.level + 1 FROM k JOIN dag d ON d.src = k.node) SELECT * FROM k) GROUP BY 1""")
def tsort_levels(f: Facts):
    edges = cut(f.acyclic_edges())
    return dag.levels(edges, edges.select(F.col("src").alias("node")).union(edges.select("dst")))[0]


def _score_sql(a: str, b: str, name: str) -> str:
    """Sums over all paths, as the scores are linear: a path ends in 1 at a leaf, in 0.1 for each relation elsewhere."""
    return f"""{name}_e AS (SELECT {a} AS x, {b} AS y FROM dag), {name}_i AS (SELECT y, count(*) AS inv FROM {name}_e GROUP BY 1), {name}_o AS (SELECT x, count(*) AS n FROM {name}_e GROUP BY 1),
{name}_p(start, node, f) AS (SELECT node, node, CAST(1 AS DOUBLE) FROM ns UNION ALL SELECT p.start, e.y, p.f / i.inv FROM {name}_p p JOIN {name}_e e ON e.x = p.node JOIN {name}_i i ON i.y = e.y),
{name} AS (SELECT start AS node, sum(f * coalesce(CAST(0.1 AS DOUBLE) * n, 1)) AS weight, sum(coalesce(CAST(0.1 AS DOUBLE) * n, 1)) AS total FROM {name}_p LEFT JOIN {name}_o o ON o.x = node GROUP BY 1)"""


_HOT = f"WITH RECURSIVE ns AS (SELECT src AS node FROM dag UNION SELECT dst FROM dag), {_score_sql('src', 'dst', 'down')}, {_score_sql('dst', 'src', 'up')} SELECT node, up.weight AS uw, up.total AS us, down.weight AS dw, down.total AS ds, (up.weight - 1) * (down.weight - 1) AS b FROM up JOIN down USING (node)"


@query(f"SELECT node, round(uw, 6) + 0.0 AS up_weight, round(us, 6) + 0.0 AS up_sum, round(dw, 6) + 0.0 AS down_weight, round(ds, 6) + 0.0 AS down_sum, round(b, 6) + 0.0 AS badness FROM ({_HOT})")
def hot_scores(f: Facts):
    s = hot.scores(f.acyclic_edges())
    return s.select("node", *((F.round(c, 6) + 0.0).alias(c) for c in s.columns[1:]))


@query(f"SELECT node, CAST(floor(b + 0.5) AS BIGINT) AS badness FROM ({_HOT}) ORDER BY round(b, 6) DESC, node LIMIT 10")
def hot_top10(f: Facts):
    return hot.hottest(hot.scores(f.acyclic_edges()).withColumn("badness", F.round("badness", 6)))


@query(f"""SELECT node, up_next, down_next FROM (WITH h AS ({_HOT}),
u AS (SELECT dst AS node, src AS up_next FROM dag JOIN h ON h.node = src QUALIFY row_number() OVER (PARTITION BY dst ORDER BY round(us, 6) DESC, src) = 1),
d AS (SELECT src AS node, dst AS down_next FROM dag JOIN h ON h.node = dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(ds, 6) DESC, dst) = 1)
SELECT h.node, up_next, down_next FROM h LEFT JOIN u ON u.node = h.node LEFT JOIN d ON d.node = h.node)""")
def hot_chain(f: Facts):
    edges = cut(f.acyclic_edges())
    s = hot.scores(edges)
    return hot.best_next(edges, cut(s.select("node", F.round("up_sum", 6).alias("up_sum"), F.round("down_sum", 6).alias("down_sum"))))


@query(f"SELECT round(min(b), 6) AS least, round(max(b) FILTER (k = n // 2), 6) AS middle, round(max(b), 6) AS most FROM (SELECT b, row_number() OVER (ORDER BY b) - 1 AS k, count(*) OVER () AS n FROM ({_HOT}))")
def hot_spread(f: Facts):
    s = hot.spread(cut(hot.scores(f.acyclic_edges())))
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


# Text, files and configurations


@query("SELECT page_id, CASE WHEN instr(html, '<script') = 0 THEN '' ELSE split_part(substr(substr(html, instr(html, '<script')), instr(substr(html, instr(html, '<script')), '>') + 1), '</script>', 1) END AS script FROM pages", "")
def script_extract(f: Facts):
    return f.table("pages").select("page_id", text.script_of("html").alias("script"))


@query("SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) || u.h AS target FROM pages, LATERAL (SELECT DISTINCT unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS h) u", "")
def link_resolve(f: Facts):
    hrefs = f.table("pages").select("page_id", "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1)))).alias("h"))
    return hrefs.select("page_id", F.concat(F.regexp_extract("url", "^(https?://[^/]+)", 1), paths.normalised("h")).alias("target"))


@query("""SELECT path, coalesce(CASE WHEN key % 40 = 1 THEN '/repo/pkg' || (key % 6) || '/d1/tsconfig.json' WHEN key % 6 < 3 THEN '/repo/pkg' || (key % 6) || '/tsconfig.json' END, '/repo/tsconfig.json') AS tsconfig FROM modules""")
def nearest_config(f: Facts):
    known = ["/repo/tsconfig.json", *(f"/repo/pkg{k}/tsconfig.json" for k in range(3)), *(f"/repo/pkg{k}/d1/tsconfig.json" for k in range(6))]
    configs = f.spark.createDataFrame([(c,) for c in known], "path string")
    return resolve.nearest_config(f.modules().select("path"), configs)


@query("""SELECT CASE WHEN doc_id % 5 = 0 THEN 'missing' WHEN sha256(text) = sha256(CASE WHEN doc_id % 2 = 0 THEN text ELSE text || 'x' END) THEN 'same' ELSE 'changed' END AS state, count(*) AS n FROM documents GROUP BY 1""", "")
def checksum_validate(f: Facts):
    from modweave.plans.model import validate_checksums

    docs = f.table("documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), "doc_id")
    planned = docs.select("path", text.checksum(F.when(F.col("doc_id") % 2 == 0, F.col("content")).otherwise(F.concat("content", F.lit("x")))).alias("expected"))
    return validate_checksums(planned, docs.filter("doc_id % 5 <> 0").select("path", "content")).groupBy("state").agg(F.count("*").alias("n"))


@query("""SELECT path, type, CAST(lines AS INTEGER) AS lines, CAST(lines - coalesce(before, 0) AS INTEGER) AS delta FROM (SELECT CAST(b.doc_id AS VARCHAR) AS path, CASE WHEN b.doc_id % 5 = 0 THEN 'delete-file' WHEN b.doc_id % 7 = 0 THEN 'create-file' ELSE 'modify-file' END AS type,
CASE WHEN b.doc_id % 5 = 0 THEN 0 ELSE len(string_split(a.text, chr(10))) END AS lines, CASE WHEN b.doc_id % 7 <> 0 OR b.doc_id % 5 = 0 THEN len(string_split(b.text, chr(10))) END AS before FROM documents a JOIN documents b ON a.doc_id = b.doc_id + 1)""", "")
def change_stats(f: Facts):
    from modweave.plans.model import stats

    docs = f.table("documents").select("doc_id", "text")
    kind = F.when(F.col("doc_id") % 5 == 0, "delete-file").when(F.col("doc_id") % 7 == 0, "create-file").otherwise("modify-file")
    after = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("content")).join(docs.select("doc_id"), "doc_id")
    changed = after.select(F.col("doc_id").cast("string").alias("path"), kind.alias("type"), "content")
    files = docs.filter("doc_id % 7 <> 0 OR doc_id % 5 = 0").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    return stats(changed, files)


@query("SELECT doc_id FROM documents WHERE doc_id % 4 <> 0", "")
def generated_filter(f: Facts):
    code = F.when(F.col("doc_id") % 4 == 0, "/* made by a tool\n @generated */\n").when(F.col("doc_id") % 4 == 1, "const s = '@generated';\n").otherwise("let x; // plain\n")
    return f.table("documents").select("doc_id", code.alias("text")).filter(~text.is_generated("text")).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'new' ELSE 'changed' END AS state FROM documents WHERE doc_id % 7 = 0 OR doc_id % 3 = 0", "")
def changed_files(f: Facts):
    from modweave.sources.store import changed

    docs = f.table("documents")
    now = docs.select(F.col("doc_id").cast("string").alias("path"), F.col("n_chars").cast("double").alias("mtime_ms"))
    before = docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("path"), (F.col("n_chars") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).cast("double").alias("mtime_ms"))
    return changed(now, before).select(F.col("path").cast("long").alias("doc_id"), "state")


# Source texts that say what the facts say, through the extractor and the rewrites


def _wide(f: Facts) -> DataFrame:
    from modweave.sources.files import extract

    return extract(f.sources())


_SPEC = "'../../pkg' || (b % 6) || '/d' || (b % 40) || '/m' || b"


@query(f"SELECT DISTINCT path, CASE WHEN symbol_name = '*' THEN 'ns' ELSE symbol_name END || '_m' || b AS local_name, {_SPEC} AS spec FROM import_keys JOIN modules ON key = a")
def extracted_imports(f: Facts):
    return _wide(f).select("path", F.explode("imports").alias("i")).select("path", F.col("i.local").alias("local_name"), F.col("i.spec").alias("spec"))


@query("SELECT path, symbol_name, module_spec FROM reexports")
def extracted_reexports(f: Facts):
    return _wide(f).select("path", F.explode("reexports").alias("r")).select("path", F.col("r.name").alias("symbol_name"), F.col("r.spec").alias("module_spec"))


@query("SELECT path, nodejs FROM needs")
def extracted_needs(f: Facts):
    return _wide(f).select("path", (F.size("node_globals") > 0).alias("nodejs"))


@query("SELECT DISTINCT importer_path, importer_tsconfig, exporter_path, exporter_tsconfig FROM imports WHERE exporter_path IS NOT NULL")
def extracted_edges(f: Facts):
    from modweave.sources.files import extract, facts

    files = f.sources()
    configs = f.modules().select(F.col("tsconfig").alias("path")).distinct().select("path", F.create_map().cast("map<string,array<string>>").alias("paths"), F.lit(None).cast("string").alias("base_url"), F.lit(None).cast("string").alias("root_dir"))
    imports = facts(extract(files), files, configs)["imports"]
    return imports.filter("exporter_path IS NOT NULL").select("importer_path", "importer_tsconfig", "exporter_path", "exporter_tsconfig").distinct()


@query("SELECT x.path AS path, count(DISTINCT (a.b, a.symbol_name = '*')) AS declarations FROM import_keys a JOIN modules x ON x.key = a.a GROUP BY 1 HAVING count(DISTINCT (a.b, a.symbol_name)) > count(DISTINCT (a.b, a.symbol_name = '*'))")
def normalized_imports(f: Facts):
    from modweave.plans.proposals import normalize_imports

    lines = F.filter(F.split("new", "\n"), lambda x: x.startswith("import "))
    return normalize_imports(f.sources(merged=False), "/repo").select("path", F.size(lines).cast("long").alias("declarations"))


@query("""SELECT path, count(*) FILTER (kept) AS kept FROM (SELECT path, EXISTS (SELECT 1 FROM imports i WHERE i.exporter_path = r.path AND i.symbol_name IN (r.symbol_name, '*')) AS kept FROM reexports r) GROUP BY 1 HAVING count(*) FILTER (NOT kept) > 0""")
def purged_reexports(f: Facts):
    from modweave.plans.proposals import purge_reexports

    lines = F.filter(F.split("new", "\n"), lambda x: x.startswith("export {"))
    return purge_reexports(f.sources(), f.imports(), f.reexports()).select("path", F.size(lines).cast("long").alias("kept"))


@query(f"SELECT DISTINCT importer_path AS path FROM imports WHERE exporter_path = '{_path(5)}'")
def moved_importers(f: Facts):
    from modweave.plans.proposals import move_file

    edits = move_file(f.sources(), f.imports(), _path(5), "/repo/moved/m5.ts")
    return edits.filter((F.col("path") != _path(5)) & F.col("new").contains("'../../moved/m5'")).select("path")
