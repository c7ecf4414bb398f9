"""Look-ups, groupings and set operations on the import facts.

All are plain selections, joins and aggregations: paths and names are ordinary columns, so an
equality filter reaches the scan and a look-up of many keys is an equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def within(path: Column | str, folder: str, strict: bool = True) -> Column:
    """Whether a path lies in a folder; not strict also takes names that merely begin alike."""
    c = F.col(path) if isinstance(path, str) else path
    return c.startswith(folder.rstrip("/") + "/") if strict else c.startswith(folder)


def resolved(imports: DataFrame) -> DataFrame:
    """Imports whose exporter is a file of the repository."""
    return imports.filter(F.col("exporter_path").isNotNull())


def exporters_of(imports: DataFrame, path: str) -> DataFrame:
    """What a file imports: a row per imported name, unresolved ones left out."""
    return resolved(imports.filter(F.col("importer_path") == path)).select("exporter_path", "exporter_tsconfig", "symbol_name")


def importers_of(imports: DataFrame, path: str) -> DataFrame:
    """Distinct files that import a file."""
    return imports.filter(F.col("exporter_path") == path).select("importer_path").distinct()


def importers_of_symbol(imports: DataFrame, path: str, name: str) -> DataFrame:
    """Files that import a name from a file, a row per import."""
    return imports.filter((F.col("exporter_path") == path) & (F.col("symbol_name") == name)).select("importer_path")


def imports_of_symbol(imports: DataFrame, name: str) -> DataFrame:
    """All imports of a name, whatever its module."""
    return resolved(imports).filter(F.col("symbol_name") == name)


def unresolved(imports: DataFrame) -> DataFrame:
    """(exporter_spec, importers, uses) of packages."""
    return imports.filter(F.col("exporter_path").isNull()).groupBy("exporter_spec").agg(F.count_distinct("importer_path").alias("importers"), F.count("*").alias("uses"))


def _between(imports: DataFrame, from_config: str, to_config: str) -> DataFrame:
    return imports.filter((F.col("importer_tsconfig") == from_config) & (F.col("exporter_tsconfig") == to_config))


def project_use(imports: DataFrame, from_config: str, to_config: str) -> DataFrame:
    """(exporter_path, importers): who in one project uses the modules of another."""
    return _between(imports, from_config, to_config).groupBy("exporter_path").agg(F.sort_array(F.collect_set("importer_path")).alias("importers"))


def project_use_symbols(imports: DataFrame, from_config: str, to_config: str) -> DataFrame:
    """(exporter_path, symbol_name, importers)."""
    return _between(imports, from_config, to_config).groupBy("exporter_path", "symbol_name").agg(F.sort_array(F.collect_set("importer_path")).alias("importers"))


def project_folder(project: str) -> str:
    """The folder of a project, which is named by it or by its configuration."""
    return project.rsplit("/", 1)[0] if project.endswith(".json") else project


def symbol_usage(imports: DataFrame, project: str, name: str) -> DataFrame:
    """(exporter_path, importer_path): importers of a name that a project (folder or configuration) exports."""
    return imports.filter(within("exporter_path", project_folder(project)) & (F.col("symbol_name") == name)).select("exporter_path", "importer_path").distinct()


def imports_from(imports: DataFrame, path: str) -> DataFrame:
    """All imports of a file, unresolved ones too."""
    return imports.filter(F.col("importer_path") == path)


def reexports_of(reexports: DataFrame, path: str) -> DataFrame:
    """What a file exports again."""
    return reexports.filter(F.col("path") == path)


def reexports_named(reexports: DataFrame, name: str) -> DataFrame:
    """Who exports a name again."""
    return reexports.filter(F.col("symbol_name") == name)


def _traced(imports: DataFrame, start: str) -> DataFrame:
    """Resolved imports of a file, or of the files of a folder."""
    return resolved(imports).filter((F.col("importer_path") == start) | within("importer_path", start))


def trace_imports(imports: DataFrame, start: str, from_project: str | None = None) -> DataFrame:
    """(exporter_path, symbols): what a file, or the files of a folder, import, optionally of one project (folder or configuration)."""
    rows = _traced(imports, start)
    rows = rows if from_project is None else rows.filter(within("exporter_path", project_folder(from_project)))
    return rows.groupBy("exporter_path").agg(F.sort_array(F.collect_set("symbol_name")).alias("symbols"))


def trace_total(imports: DataFrame, start: str) -> DataFrame:
    """(exporters, symbols): totals of :func:`trace_imports`."""
    rows = _traced(imports, start).select("exporter_path", "symbol_name").distinct()
    return rows.groupBy("exporter_path").agg(F.count("*").alias("n")).agg(F.count("*").alias("exporters"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"))


def definitions(imports: DataFrame, folder: str, name: str) -> DataFrame:
    """Files of a folder from which a name is imported."""
    return imports_of_symbol(imports, name).filter(within("exporter_path", folder)).select("exporter_path").distinct()


def uses(imports: DataFrame, folder: str, name: str) -> DataFrame:
    """(exporter_path, importers, n) of a name's exporters in a folder."""
    return imports_of_symbol(imports, name).filter(within("exporter_path", folder)).groupBy("exporter_path").agg(F.sort_array(F.collect_set("importer_path")).alias("importers"), F.count_distinct("importer_path").alias("n"))


def module_graph(imports: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) of resolved imports, with both ends among ``files`` (path) if given."""
    e = resolved(imports).select(F.col("importer_path").alias("src"), F.col("exporter_path").alias("dst")).distinct()
    if files is None:
        return e
    f = files.select("path").distinct()
    return e.join(f, e["src"] == f["path"], "left_semi").join(f, e["dst"] == f["path"], "left_semi")


def same_project(imports: DataFrame, config: str) -> DataFrame:
    """Module edges that stay in one project."""
    return module_graph(imports.filter((F.col("importer_tsconfig") == config) & (F.col("exporter_tsconfig") == config)))


def folder_of(path: Column | str) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def directory_graph(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) folders of module edges, without edges inside a folder."""
    return edges.select(folder_of("src").alias("src"), folder_of("dst").alias("dst")).filter("src <> dst").distinct()


def fan_in_out(edges: DataFrame) -> DataFrame:
    """(node, fan_in, fan_out) in one pass over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    return ends.groupBy("x.node").agg(F.sum("x.i").alias("fan_in"), F.sum("x.o").alias("fan_out"))


def direct_candidates(imports: DataFrame, reexports: DataFrame) -> DataFrame:
    """Imports of a name through a file that re-exports it: importer, via, symbol, target spec."""
    r = reexports.select(F.col("path").alias("exporter_path"), "symbol_name", "module_spec", "is_type_only")
    return resolved(imports).join(r, ["exporter_path", "symbol_name"]).select("importer_path", F.col("exporter_path").alias("via"), "symbol_name", "module_spec", "is_type_only")


def exporting(candidates: DataFrame, exports: DataFrame, path: str = "original_path") -> DataFrame:
    """Candidates whose original module exports the name itself."""
    x = exports.select(F.col("path").alias(path), "symbol_name").distinct()
    return candidates.join(x, [path, "symbol_name"], "left_semi")


def unused_reexports(imports: DataFrame, reexports: DataFrame) -> DataFrame:
    """Re-exports that nobody imports by name, nor by a namespace import of the file."""
    named = resolved(imports).select(F.col("exporter_path").alias("path"), "symbol_name").distinct()
    spaces = named.filter("symbol_name = '*'").select("path")
    return reexports.join(named, ["path", "symbol_name"], "left_anti").join(spaces, "path", "left_anti")


def spared_by_namespace(imports: DataFrame, reexports: DataFrame) -> DataFrame:
    """(path, skipped): re-exports that only a namespace import of the file keeps."""
    named = resolved(imports).select(F.col("exporter_path").alias("path"), "symbol_name").distinct()
    spaces = named.filter("symbol_name = '*'").select("path")
    return reexports.join(named, ["path", "symbol_name"], "left_anti").join(spaces, "path", "left_semi").groupBy("path").agg(F.count("*").alias("skipped"))


def reexport_counts(imports: DataFrame, reexports: DataFrame) -> DataFrame:
    """(path, total, public, unused): conditional counts for each file, one join for all of them."""
    named = resolved(imports).select(F.col("exporter_path").alias("path"), "symbol_name", F.lit(True).alias("used")).distinct()
    return reexports.join(named, ["path", "symbol_name"], "left").groupBy("path").agg(F.count("*").alias("total"), F.count_if("public").alias("public"), F.count_if(F.col("used").isNull() & ~F.col("public")).alias("unused"))


def users_of_types(imports: DataFrame, names: list[str], include_definers: bool = False, folder: str | None = None) -> DataFrame:
    """Files (of a folder) that import any of the names, packages' too, without the files that define them for these importers, unless asked for."""
    rows = imports.filter(F.col("symbol_name").isin(names))
    rows = rows if folder is None else rows.filter(within("importer_path", folder))
    users = rows.select(F.col("importer_path").alias("path")).distinct()
    return users if include_definers else users.join(resolved(rows).select(F.col("exporter_path").alias("path")).distinct(), "path", "left_anti")


def only_used_by(uses: DataFrame, symbols: list[str]) -> DataFrame:
    """Imports (path, import_name) used by the symbols (path, symbol_name, import_name) and by no others."""
    mine = uses.filter(F.col("symbol_name").isin(symbols)).select("path", "import_name")
    return mine.subtract(uses.filter(~F.col("symbol_name").isin(symbols)).select("path", "import_name"))
