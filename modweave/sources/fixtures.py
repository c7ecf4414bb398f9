"""Module facts derived from the order tables, for queries that are checked with SQL.

One module for each part. Line 1 of an order gives imports between blocks of four modules, always
from the higher key to the lower; line 2 gives imports inside a block, which form the cycles; line
4 gives namespace imports; line 7 gives imports of packages; line 3 gives re-exports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def module_path(key: Column | str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("/repo/pkg"), (k % 6).cast("string"), F.lit("/d"), (k % 40).cast("string"), F.lit("/m"), k.cast("string"), F.lit(".ts"))


def module_config(key: Column | str) -> Column:
    k = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("/repo/pkg"), (k % 6).cast("string"), F.lit("/tsconfig.json"))


class Facts:
    """Lazy fact tables over one folder of order tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def modules(self) -> DataFrame:
        """(key, path, tsconfig, size)"""
        return self.table("part").select(F.col("p_partkey").alias("key"), module_path("p_partkey").alias("path"), module_config("p_partkey").alias("tsconfig"), F.col("p_size").alias("size"))

    def import_keys(self) -> DataFrame:
        """(a, b, symbol_name, import_index, kind): importer and exporter keys, one row per imported name."""
        n = self.table("part").count()
        line = self.table("lineitem").select("l_partkey", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity").filter("(l_linenumber = 1 AND l_quantity <= 6) OR (l_linenumber = 2 AND l_quantity <= 20) OR (l_linenumber = 4 AND l_quantity = 1)")
        far = F.col("l_orderkey") % n
        near = F.expr("(l_partkey div 4) * 4 + l_orderkey % 4")
        inside = F.col("l_linenumber") == 2
        a = F.when(inside, F.col("l_partkey")).otherwise(F.greatest("l_partkey", far))
        b = F.when(inside, near).otherwise(F.least("l_partkey", far))
        symbol = F.when(F.col("l_linenumber") == 4, F.lit("*")).otherwise(F.concat(F.lit("sym"), (F.col("l_suppkey") % 50).cast("string")))
        rows = line.select(a.alias("a"), b.alias("b"), symbol.alias("symbol_name"), F.col("l_orderkey").cast("int").alias("import_index"), F.when(inside, "local").otherwise("cross").alias("kind"))
        return rows.filter("a <> b AND (kind = 'local' OR a div 4 <> b div 4)")

    def imports(self) -> DataFrame:
        """The import facts, resolved and not."""
        known = self.import_keys().select(module_path("a").alias("importer_path"), module_config("a").alias("importer_tsconfig"), "import_index", "symbol_name", module_path("b").alias("exporter_path"), module_config("b").alias("exporter_tsconfig"), F.lit(None).cast("string").alias("exporter_spec"))
        line = self.table("lineitem").filter("l_linenumber = 7")
        none = F.lit(None).cast("string")
        outside = line.select(module_path("l_partkey").alias("importer_path"), module_config("l_partkey").alias("importer_tsconfig"), F.col("l_orderkey").cast("int").alias("import_index"), none.alias("symbol_name"), none.alias("exporter_path"), none.alias("exporter_tsconfig"), F.concat(F.lit("ext/"), (F.col("l_suppkey") % 20).cast("string")).alias("exporter_spec"))
        return known.unionByName(outside)

    def reexports(self) -> DataFrame:
        """(path, symbol_name, module_spec, is_type_only, public), distinct by path and name."""
        line = self.table("lineitem").filter("l_linenumber = 3")
        name = F.concat(F.lit("sym"), (F.col("l_suppkey") % 50).cast("string"))
        return line.groupBy(F.col("l_partkey").alias("key"), name.alias("symbol_name")).agg(F.min("l_orderkey").alias("o")).select(module_path("key").alias("path"), "symbol_name", F.concat(F.lit("./m"), (F.col("o") % 100).cast("string")).alias("module_spec"), (F.col("o") % 2 == 0).alias("is_type_only"), (F.col("o") % 7 == 0).alias("public"))

    def needs(self) -> DataFrame:
        return self.modules().select("path", (F.col("size") <= 2).alias("nodejs"))

    def edges(self) -> DataFrame:
        """Distinct (src, dst) keys: src imports dst."""
        return self.import_keys().select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()

    def acyclic_edges(self) -> DataFrame:
        """Edges between blocks only."""
        return self.import_keys().filter("kind = 'cross'").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()


    def sources(self, merged: bool = True) -> DataFrame:
        """(path, mtime_ms, content): a source text for each module that says what the facts say.

        Names carry the key of their module, so none is imported twice. Unless ``merged``, every
        name has an import declaration of its own.
        """
        keys = self.import_keys().select("a", "b", "symbol_name").distinct()
        spec = F.concat(F.lit("../../pkg"), (F.col("b") % 6).cast("string"), F.lit("/d"), (F.col("b") % 40).cast("string"), F.lit("/m"), F.col("b").cast("string"))
        star = F.col("symbol_name") == "*"
        local = F.concat("symbol_name", F.lit("_m"), F.col("b").cast("string"))
        if merged:
            named = keys.filter(~star).groupBy("a", "b").agg(F.array_join(F.sort_array(F.collect_set(local)), ", ").alias("names"))
        else:
            named = keys.filter(~star).select("a", "b", local.alias("names"))
        lines = named.select("a", F.concat(F.lit("import { "), "names", F.lit(" } from '"), spec, F.lit("';")).alias("line"))
        spaces = keys.filter(star).select("a", F.concat(F.lit("import * as ns_m"), F.col("b").cast("string"), F.lit(" from '"), spec, F.lit("';")).alias("line"))
        texts = lines.unionByName(spaces).groupBy(module_path("a").alias("path")).agg(F.array_join(F.sort_array(F.collect_list("line")), "\n").alias("imports"))
        again = self.reexports().groupBy("path").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("export { "), "symbol_name", F.lit(" } from '"), "module_spec", F.lit("';")))), "\n").alias("exports"))
        need = F.when(F.col("nodejs"), "export const home = process.env.HOME;").otherwise("export type Process = typeof process;")
        parts = self.needs().join(texts, "path", "left").join(again, "path", "left")
        return parts.select("path", F.lit(0.0).alias("mtime_ms"), F.concat_ws("\n", "imports", "exports", need, F.lit("")).alias("content"))


#: The same tables for DuckDB, as the head of a query.
SQL = """
WITH RECURSIVE n AS (SELECT count(*) AS n FROM part),
modules AS (SELECT p_partkey AS key, '/repo/pkg' || (p_partkey % 6) || '/d' || (p_partkey % 40) || '/m' || p_partkey || '.ts' AS path,
  '/repo/pkg' || (p_partkey % 6) || '/tsconfig.json' AS tsconfig, p_size AS size FROM part),
raw AS (
  SELECT greatest(l_partkey, l_orderkey % n) AS a, least(l_partkey, l_orderkey % n) AS b, 'sym' || (l_suppkey % 50) AS symbol_name, l_orderkey AS import_index, 'cross' AS kind
  FROM lineitem, n WHERE l_linenumber = 1 AND l_quantity <= 6
  UNION ALL SELECT l_partkey, (l_partkey // 4) * 4 + l_orderkey % 4, 'sym' || (l_suppkey % 50), l_orderkey, 'local' FROM lineitem WHERE l_linenumber = 2 AND l_quantity <= 20
  UNION ALL SELECT greatest(l_partkey, l_orderkey % n), least(l_partkey, l_orderkey % n), '*', l_orderkey, 'cross' FROM lineitem, n WHERE l_linenumber = 4 AND l_quantity = 1),
import_keys AS (SELECT * FROM raw WHERE a <> b AND (kind = 'local' OR a // 4 <> b // 4)),
imports AS (
  SELECT x.path AS importer_path, x.tsconfig AS importer_tsconfig, CAST(import_index AS INTEGER) AS import_index, symbol_name, y.path AS exporter_path, y.tsconfig AS exporter_tsconfig, CAST(NULL AS VARCHAR) AS exporter_spec
  FROM import_keys JOIN modules x ON x.key = a JOIN modules y ON y.key = b
  UNION ALL SELECT path, tsconfig, CAST(l_orderkey AS INTEGER), NULL, NULL, NULL, 'ext/' || (l_suppkey % 20) FROM lineitem JOIN modules ON key = l_partkey WHERE l_linenumber = 7),
reexports AS (SELECT path, symbol_name, './m' || (o % 100) AS module_spec, o % 2 = 0 AS is_type_only, o % 7 = 0 AS public
  FROM (SELECT l_partkey, 'sym' || (l_suppkey % 50) AS symbol_name, min(l_orderkey) AS o FROM lineitem WHERE l_linenumber = 3 GROUP BY ALL) JOIN modules ON key = l_partkey),
needs AS (SELECT path, size <= 2 AS nodejs FROM modules),
edges AS (SELECT DISTINCT a AS src, b AS dst FROM import_keys),
dag AS (SELECT DISTINCT a AS src, b AS dst FROM import_keys WHERE kind = 'cross'),
nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges)
"""
#: Cycles, condensation and depth on top of ``SQL``: closure by a recursive union.
SCC_SQL = SQL.rstrip() + """,
closure(src, dst) AS (SELECT src, dst FROM edges UNION SELECT c.src, e.dst FROM closure c JOIN edges e ON c.dst = e.src),
mutual AS (SELECT x.src AS node, x.dst AS other FROM closure x JOIN closure y ON x.src = y.dst AND x.dst = y.src),
scc AS (SELECT node, least(node, coalesce((SELECT min(other) FROM mutual m WHERE m.node = nodes.node), node)) AS scc_id FROM nodes),
condensed AS (SELECT DISTINCT x.scc_id AS src_scc, y.scc_id AS dst_scc FROM edges JOIN scc x ON x.node = src JOIN scc y ON y.node = dst WHERE x.scc_id <> y.scc_id),
leaves AS (SELECT DISTINCT scc_id FROM scc WHERE scc_id NOT IN (SELECT src_scc FROM condensed)),
levels(scc_id, depth) AS (SELECT scc_id, 0 FROM leaves UNION SELECT c.src_scc, l.depth + 1 FROM levels l JOIN condensed c ON c.dst_scc = l.scc_id WHERE l.depth < 60),
depths AS (SELECT scc_id, min(depth) AS depth FROM levels GROUP BY 1)
"""
