"""Specifiers to paths and back, and the nearest configuration of a file.

A file's folders are exploded, so the nearest configuration is an equi-join and a maximum, and
aliases meet specifiers by the project they belong to; nothing is compared with everything.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from modweave.functions.paths import ancestors, dirname, joined


def nearest_config(files: DataFrame, configs: DataFrame) -> DataFrame:
    """``files`` (path) with ``tsconfig``: the ``tsconfig.json`` (configs.path) of the closest folder, or null."""
    up = files.select("path").distinct().select("path", F.explode(ancestors("path")).alias("folder"))
    known = configs.select(dirname("path").alias("folder"), F.col("path").alias("config"))
    best = up.join(known, "folder").groupBy("path").agg(F.max_by("config", F.length("folder")).alias("tsconfig"))
    return files.join(best, "path", "left")


def folders(files: DataFrame) -> DataFrame:
    """(folder): every folder that holds a file, at any depth."""
    return files.select(F.explode(ancestors("path")).alias("folder")).filter("folder <> ''").distinct()


def _module_file(rows: DataFrame, candidate: str, files: DataFrame, out: str) -> DataFrame:
    """``rows`` with the source file of an absolute ``candidate`` path, or null.

    The parent must be a folder. A folder gives its index file; ``.js`` and ``.mjs`` become their
    sources; anything else gets ``.ts``. Whether the file exists is not asked.
    """
    every = folders(files)
    parent = every.select(F.col("folder").alias("_parent"), F.lit(True).alias("_has_parent"))
    itself = every.select(F.col("folder").alias(candidate), F.lit(True).alias("_is_folder"))
    c = F.col(candidate)
    path = F.when(F.col("_has_parent").isNull(), None).when(F.col("_is_folder"), F.concat(c, F.lit("/index.ts"))).when(c.endswith(".mjs"), F.regexp_replace(c, r"\.mjs$", ".mts")).when(c.endswith(".js"), F.regexp_replace(c, r"\.js$", ".ts")).otherwise(F.concat(c, F.lit(".ts")))
    found = rows.withColumn("_parent", dirname(candidate)).join(parent, "_parent", "left").join(itself, candidate, "left")
    return found.withColumn(out, path).drop("_parent", "_has_parent", "_is_folder")


def aliases(configs: DataFrame) -> DataFrame:
    """(tsconfig, position, prefix, target) of ``paths`` entries (alias ``x/*`` to one target ``y/*``).

    Other shapes are refused. The target is absolute, from the configuration's folder and base URL.
    """
    rows = configs.select(F.col("path").alias("tsconfig"), dirname("path").alias("folder"), "base_url", F.posexplode(F.map_entries("paths")).alias("position", "entry"))
    good = F.col("entry.key").endswith("/*") & (F.size("entry.value") == 1) & F.col("entry.value")[0].endswith("/*")
    rows = rows.withColumn("entry", F.when(good, F.col("entry")).otherwise(F.raise_error(F.concat(F.lit("unsupported alias "), F.col("entry.key")))))
    cut = lambda c: F.regexp_replace(c, r"\*$", "")
    base = F.when(F.col("base_url").isNull(), F.col("folder")).otherwise(joined(F.col("folder"), F.col("base_url")))
    return rows.select("tsconfig", "position", cut(F.col("entry.key")).alias("prefix"), joined(base, cut(F.col("entry.value")[0])).alias("target"))


def resolve_specifiers(imports: DataFrame, files: DataFrame, configs: DataFrame) -> DataFrame:
    """``imports`` (path, tsconfig, spec, ...) with ``exporter_path``: relative first, then by alias; null for packages.

    Aliases are joined by project and the prefix is checked there; the first entry that gives a
    file wins.
    """
    ids = imports.withColumn("_id", F.struct("path", "tsconfig", "spec"))
    keys = ids.select("_id", "path", "tsconfig", "spec").distinct()
    near = _module_file(keys.filter(F.col("spec").startswith(".")).withColumn("_full", joined(dirname("path"), F.col("spec"))), "_full", files, "relative").select("_id", "relative")
    named = keys.join(aliases(configs), "tsconfig").filter(F.col("spec").startswith(F.col("prefix")))
    named = named.withColumn("_full", F.concat_ws("/", "target", F.expr("substring(spec, length(prefix) + 1)")))
    far = _module_file(named, "_full", files, "aliased").filter("aliased IS NOT NULL").groupBy("_id").agg(F.min_by("aliased", "position").alias("aliased"))
    return ids.join(near, "_id", "left").join(far, "_id", "left").withColumn("exporter_path", F.coalesce("relative", "aliased")).drop("_id", "relative", "aliased")


def relative_to(path: Column, importer: Column) -> Column:
    """Relative specifier of a module from an importer, without extension."""
    a, b = F.split(path, "/"), F.split(importer, "/")
    shorter = F.least(F.size(a), F.size(b)) - 1
    same = F.aggregate(F.sequence(F.lit(0), shorter - 1), F.struct(F.lit(True).alias("on"), F.lit(0).alias("n")), lambda s, i: F.struct((s["on"] & (F.get(a, i) == F.get(b, i))).alias("on"), (s["n"] + (s["on"] & (F.get(a, i) == F.get(b, i))).cast("int")).alias("n")))["n"]
    up = F.repeat(F.lit("../"), F.size(b) - 1 - same)
    down = F.regexp_replace(F.array_join(F.slice(a, same + 1, F.size(a) - same), "/"), r"\.ts$", "")
    return F.concat(F.when(up == "", "./").otherwise(up), down)


def specifier_for(uses: DataFrame, configs: DataFrame) -> DataFrame:
    """``uses`` (path, importer_path, tsconfig of the importer) with ``spec``: :func:`specifier_of`, else relative if both lie in the project, else null."""
    folder = F.concat(dirname("tsconfig"), F.lit("/"))
    inside = F.col("path").startswith(folder) & F.col("importer_path").startswith(folder)
    return specifier_of(uses, configs).withColumn("spec", F.coalesce("spec", F.when(inside, relative_to(F.col("path"), F.col("importer_path")))))


def specifier_of(paths: DataFrame, configs: DataFrame) -> DataFrame:
    """``paths`` (path, tsconfig) with ``spec``: by the first alias whose target holds the path, without extension; else null."""
    named = paths.select("path", "tsconfig").distinct().join(aliases(configs), "tsconfig").filter(F.col("path").startswith(F.concat("target", F.lit("/"))))
    tail = F.regexp_replace(F.expr("substring(path, length(target) + 2)"), r"\.ts$", "")
    best = named.select("path", "tsconfig", "position", F.concat("prefix", tail).alias("spec")).groupBy("path", "tsconfig").agg(F.min_by("spec", "position").alias("spec"))
    return paths.join(best, ["path", "tsconfig"], "left")


def replaced_types(imports: DataFrame, source_module: str) -> DataFrame:
    """Imports (spec, exporter_path) of a module that is named exactly, or by the end of its path."""
    m = source_module.removeprefix("./")
    return imports.filter((F.col("spec") == source_module) | F.col("spec").endswith(f"/{m}") | F.col("exporter_path").endswith(f"/{m}") | F.col("exporter_path").endswith(f"/{m}.ts"))
