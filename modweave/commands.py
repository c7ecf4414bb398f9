"""The command surface: one function for each command, and a command line over them.

    python -m modweave.commands hot src

Commands read the repository that holds the given path, or facts given as DataFrames.
"""

from __future__ import annotations

import argparse
import posixpath
import subprocess
import sys
from collections import Counter
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from modweave.functions import render
from modweave.functions.paths import absolute, display
from modweave.functions.text import source_text
from modweave.functions.typescript import Module
from modweave.operators import dag, hot, lookups, reach, resolve, scc
from modweave.plans import model, proposals
from modweave.runtime import cut
from modweave.sources import files as sources
from modweave.sources.store import repository_root

PLAN_FILE = ".modweave-plan.json"


@dataclass
class Index:
    """Files and facts of a repository."""

    files: DataFrame
    configs: DataFrame
    tables: dict[str, DataFrame]
    cwd: str = "/"

    @property
    def imports(self) -> DataFrame:
        return self.tables["imports"]

    def edges(self) -> DataFrame:
        return lookups.module_graph(self.imports)

    def config_of(self, path: str) -> str | None:
        row = resolve.nearest_config(self.files.filter(F.col("path") == path).select("path"), self.configs).first()
        return row["tsconfig"] if row else None

    def text(self, path: str) -> str:
        row = self.files.filter(F.col("path") == path).select(source_text("path", "content").alias("t")).first()
        if row is None:
            raise FileNotFoundError(path)
        return row["t"]


def index(files: DataFrame, cwd: str = "/") -> Index:
    """Extract and resolve all facts of files (path, mtime_ms, content), configurations among them."""
    configs = cut(sources.configs(files))
    code = files.filter(F.col("path").rlike(r"\.(ts|vue)$"))
    wide = cut(sources.extract(code))
    tables = sources.facts(wide, code, configs)
    return Index(files, configs, {k: cut(v) for k, v in tables.items()} | {"wide": wide}, cwd)


def open_repository(spark: SparkSession, path: str, cwd: str) -> Index:
    root = repository_root(path)
    found = sources.scan(spark, root)
    configs = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "tsconfig.json").load(root)
    configs = configs.select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.lit(0.0).alias("mtime_ms"), F.col("content").cast("string").alias("content"))
    return index(found.unionByName(configs.filter(~F.col("path").contains("/node_modules/"))), cwd)


def _pairs(edges: DataFrame) -> list[tuple]:
    return [(r["src"], r["dst"]) for r in edges.collect()]


def _reachable(ix: Index, starts: list[str], edges: DataFrame) -> list[tuple]:
    """Edges below the starts: what a printed order is made from."""
    spark = edges.sparkSession
    below = cut(reach.dependencies(edges, spark.createDataFrame([(s,) for s in starts], "node string")))
    return _pairs(edges.join(below.select(F.col("node").alias("src")), "src", "left_semi"))


def _scoped(ix: Index, path: str, project: bool) -> DataFrame:
    if not project:
        return ix.edges()
    config = ix.config_of(path)
    return lookups.module_graph(ix.imports.filter(F.col("exporter_tsconfig") == config))


def dependencies(ix: Index, paths: list[str], project: bool = False) -> list[str]:
    return reach.post_order(_reachable(ix, paths, _scoped(ix, paths[0], project)), paths)


def imports(ix: Index, path: str) -> list[str]:
    return [r[0] for r in lookups.importers_of(ix.imports, path).orderBy("importer_path").collect()]


def import_chain(ix: Index, start: str, target: str) -> list[str]:
    weighted = lookups.resolved(ix.imports).groupBy(F.col("importer_path").alias("src"), F.col("exporter_path").alias("dst")).agg(F.count("*").alias("names"))
    weighted = cut(weighted)
    one = lambda path: weighted.sparkSession.createDataFrame([(path,)], "node string")
    between = cut(reach.dependents(weighted, one(target)).join(reach.dependencies(weighted, one(start)), "node", "left_semi"))
    part = weighted.join(between.select(F.col("node").alias("src")), "src", "left_semi").join(between.select(F.col("node").alias("dst")), "dst", "left_semi")
    return dag.import_chain([(r["src"], r["dst"], r["names"]) for r in part.collect()], start, target)


def inspect(ix: Index, path: str) -> dict:
    return ix.tables["wide"].filter(F.col("path") == path).first().asDict(recursive=True) | {"tsconfig": ix.config_of(path)}


def project_use(ix: Index, start: str, to: str, symbols: bool = False) -> DataFrame:
    return (lookups.project_use_symbols if symbols else lookups.project_use)(ix.imports, start, to)


def symbol_usage(ix: Index, project: str, symbol: str) -> DataFrame:
    return lookups.symbol_usage(ix.imports, project, symbol)


def trace_imports(ix: Index, path: str, from_project: str | None = None) -> DataFrame:
    return lookups.trace_imports(ix.imports, path, from_project)


def grep(ix: Index, folder: str, symbol: str, usage: bool = False) -> DataFrame:
    return (lookups.uses if usage else lookups.definitions)(ix.imports, folder, symbol)


def cycles(ix: Index, folder: str, directories: bool = False) -> tuple[list[list[str]], set[tuple[str, str]]]:
    edges = lookups.module_graph(ix.imports, ix.files.filter(lookups.within("path", folder)))
    edges = cut(lookups.directory_graph(edges) if directories else edges)
    found = scc.cycles(edges).groupBy("scc_id").agg(F.sort_array(F.collect_list("node")).alias("nodes")).orderBy("scc_id").collect()
    return [r["nodes"] for r in found], set(_pairs(edges))


def coupling(ix: Index, path: str, name: str | None = None, dot: bool = False, shallow: bool = False) -> str:
    module = Module(ix.text(path))
    members, edges = module.class_members(name) if name else module.module_members()
    if dot or shallow:
        return render.coupling_dot(members, edges, shallow)
    return render.coupling_text(f"{display(path, ix.cwd)}{f' class {name}' if name else ''}", members, edges)


def tscat(ix: Index, path: str) -> str:
    return ix.text(path)


def needs(ix: Index, path: str) -> list[str] | None:
    needing = {r["path"] for r in ix.tables["module_needs"].filter("nodejs").select("path").collect()}
    return reach.path_to_need(_reachable(ix, [path], ix.edges()), path, needing)


def type_leaf_usage(ix: Index, folder: str, types: list[str], everything: bool = False) -> list[str]:
    users = cut(lookups.users_of_types(ix.imports, types, everything, folder).select(F.col("path").alias("node")))
    return [r[0] for r in reach.leaf_users(ix.edges(), users).orderBy("node").collect()]


def hot_report(ix: Index, folder: str, select: str | None = None) -> str:
    edges = cut(lookups.module_graph(ix.imports, ix.files.filter(lookups.within("path", folder))))
    scored = cut(hot.scores(edges))
    top = [(r["node"], r["badness"]) for r in hot.hottest(scored).collect()]
    if not top:
        return "No modules import each other."
    chosen = select or top[0][0]
    rows = {r["node"]: r for r in scored.collect()}
    pairs = _pairs(edges)
    up = hot.chain(pairs, {n: r["up_sum"] for n, r in rows.items()}, chosen, True)
    down = hot.chain(pairs, {n: r["down_sum"] for n, r in rows.items()}, chosen, False)
    ends = hot.spread(scored).first()
    return render.top_text(top, ix.cwd) + "\n\n" + render.chain_text([(n, rows[n]["badness"]) for n in [*reversed(up), chosen, *down]], *ends, ix.cwd)


def tsort(ix: Index, paths: list[str], project: bool = False) -> list[str] | None:
    edges = _reachable(ix, paths, _scoped(ix, paths[0], project))
    return dag.toposort(edges, [*paths, *(n for e in edges for n in e)])


def cyclic_modules(ix: Index, paths: list[str], project: bool = False) -> list[str]:
    """Modules on cycles below the paths, imports of themselves included: why :func:`tsort` has no order."""
    edges = _reachable(ix, paths, _scoped(ix, paths[0], project))
    root = scc.tarjan(edges)
    many = [r for r, n in Counter(root.values()).items() if n > 1]
    return sorted({n for n, r in root.items() if r in many} | {a for a, b in edges if a == b})


def outline(ix: Index, path: str, with_imports: bool = False) -> list[tuple]:
    return [m for m in Module(ix.text(path)).outline() if with_imports or m[2] != "import"]


def outline_summary(ix: Index, path: str) -> str:
    """How many members of each type a file has, imports included."""
    counts = Counter(m[2] for m in Module(ix.text(path)).outline())
    return f"# {display(path, ix.cwd)}\nSummary: {', '.join(f'{n} {kind}' for kind, n in counts.items())}\n"


def propose_split(ix: Index, source: str, target: str, symbols: list[str]) -> model.Plan:
    return proposals.propose_split(source, ix.text(source), target, symbols)


def propose_import_directly(ix: Index, folder: str) -> model.Plan:
    wide = ix.tables["wide"]
    written = wide.select(F.col("path").alias("importer_path"), F.posexplode("imports").alias("import_index", "i")).select("importer_path", "import_index", F.col("i.spec").alias("spec"))
    found = lookups.direct_candidates(ix.imports.filter(lookups.within("importer_path", folder)), ix.tables["reexports"])
    sites = ix.imports.select("importer_path", "import_index", F.col("exporter_path").alias("via"), "symbol_name").join(written, ["importer_path", "import_index"])
    specs = found.select(F.col("via").alias("path"), F.col("module_spec").alias("spec")).distinct()
    projects = resolve.nearest_config(specs.select("path").distinct(), ix.configs)
    originals = resolve.resolve_specifiers(specs.join(projects, "path"), ix.files.select("path"), ix.configs).select(F.col("path").alias("via"), F.col("spec").alias("module_spec"), F.col("exporter_path").alias("original_path"))
    good = lookups.exporting(found.join(originals, ["via", "module_spec"]).filter("original_path IS NOT NULL"), ix.tables["exports"])
    rows = good.join(sites, ["importer_path", "via", "symbol_name"])
    return proposals.plan("propose-import-directly", proposals.import_directly(ix.files, rows.select("importer_path", "spec", "symbol_name", "original_path")))


def propose_purge_reexport(ix: Index, folder: str) -> model.Plan:
    return proposals.plan("propose-purge-reexport", proposals.purge_reexports(ix.files, ix.imports, ix.tables["reexports"]))


def normalize_imports(ix: Index, folder: str) -> model.Plan:
    return proposals.plan("normalize-imports", proposals.normalize_imports(ix.files, folder))


def normalize_namespace_imports(ix: Index, folder: str) -> model.Plan:
    return proposals.plan("normalize-namespace-imports", proposals.normalize_namespaces(ix.files, folder))


def replace_type_use(ix: Index, folder: str, old: str, new: str, source: str, target: str) -> model.Plan:
    return proposals.plan("replace-type-use", proposals.replace_type_use(ix.files, folder, old, new, source, target))


def move(ix: Index, old: str, new: str) -> model.Plan:
    plan = proposals.plan("mv", proposals.move_file(ix.files, ix.imports, old, new))
    text = next((c.content for c in plan.changes if c.path == old), None) or ix.text(old)
    rest = [c for c in plan.changes if c.path != old]
    plan.changes = [model.Change("create-file", new, text), *rest, model.Change("delete-file", old)]
    plan.checksums[old] = model.text_checksum(ix.text(old))
    return plan


def version_control_move(old: str, new: str) -> bool:
    """Tell version control of a move, if it knows the file; the file is back at its old place for the plan that moves it."""
    folder, git = posixpath.dirname(old), ["git", "-C", posixpath.dirname(old)]
    if subprocess.run([*git, "ls-files", "--error-unmatch", old], capture_output=True).returncode:
        return False
    text = Path(old).read_bytes()
    Path(new).parent.mkdir(parents=True, exist_ok=True)
    subprocess.run([*git, "mv", old, new], check=True, capture_output=True)
    Path(folder).mkdir(parents=True, exist_ok=True)
    Path(old).write_bytes(text)
    Path(new).unlink()
    return True


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="modweave")
    sub = p.add_subparsers(dest="command", required=True)

    def add(command: str, *words: str, **flags: str) -> None:
        s = sub.add_parser(command)
        for w in words:
            s.add_argument(w.rstrip("+"), nargs="+" if w.endswith("+") else None)
        for flag, kind in flags.items():
            s.add_argument(f"--{flag.replace('_', '-')}", **({"action": "store_true"} if kind == "flag" else {}))

    for name in ("dependencies", "tsort"):
        add(name, "paths+", project="flag")
    for name in ("imports", "inspect", "tscat", "needs"):
        add(name, "path")
    add("import-chain", "start", "target")
    add("mv", "start", "target")
    add("project-use", "start", "target", symbols="flag")
    add("symbol-usage", "config", "symbol")
    add("trace-imports", "path", from_project="text")
    add("grep", "path", "symbol", usage="flag")
    add("cycles", "path", directories="flag", graphviz="flag", ascii="flag", fancy="flag")
    add("coupling", "path", name="text", graphviz="flag", shallow="flag")
    add("split", "start", "target", "symbols+")
    add("propose-split", "start", "target", "symbols+")
    for name in ("propose-import-directly", "propose-purge-reexport", "normalize-namespace-imports", "normalize-imports"):
        add(name, "path")
    add("replace-type-use", "path", source_type="text", target_type="text", source_module="text", target_module="text")
    add("type-leaf-usage", "path", "types+", everything="flag")
    add("apply", force="flag", verify="text", plan="text")
    add("diff", stats="flag", names_only="flag", plan="text")
    add("hot", "path", select="text")
    add("outline", "path", verbose="flag", with_imports="flag")
    return p


def _saved(plan: model.Plan) -> str:
    if not plan.changes:
        return "Nothing to change."
    model.write_plan(plan, PLAN_FILE)
    return model.display(plan)


def _diff(spark: SparkSession, plan: model.Plan, stats: bool, names: bool) -> str:
    if names:
        return "\n".join(c.path for c in plan.changes)
    disk = model.Disk()
    rows = spark.createDataFrame([(c.type, c.path, c.content) for c in plan.changes], "type string, path string, content string")
    old = spark.createDataFrame([(c.path, disk.read(c.path)) for c in plan.changes], "path string, content string").filter("content IS NOT NULL")
    if stats:
        return "\n".join(f"{r['type']} {r['path']}: {r['lines']} lines ({r['delta']:+d})" for r in model.stats(rows, old).orderBy("path").collect())
    return "\n".join(r["diff"] for r in model.diffs(rows, old).orderBy("path").collect())


def run(spark: SparkSession, args: list[str], cwd: str) -> str:
    """One command line; returns what it prints."""
    a = _parser().parse_args(args)
    if a.command == "apply":
        return f"Applied; archived as {model.apply(a.plan or PLAN_FILE, force=a.force, verify=a.verify)}"
    if a.command == "diff":
        return _diff(spark, model.read_plan(a.plan or PLAN_FILE), a.stats, a.names_only)
    full = lambda p: absolute(p, cwd)
    first = full((getattr(a, "paths", None) or [getattr(a, "path", None) or getattr(a, "start", None) or getattr(a, "config", ".")])[0])
    ix = open_repository(spark, posixpath.dirname(first) if "." in posixpath.basename(first) else first, cwd)
    lines = lambda rows: "\n".join(rows)
    table = lambda df: "\n".join("\t".join(", ".join(x) if isinstance(x, list) else str(x) for x in r) for r in df.orderBy(*df.columns[:1]).collect())
    shown = lambda paths: lines(display(p, cwd) for p in paths)
    match a.command:
        case "dependencies":
            return shown(dependencies(ix, [full(p) for p in a.paths], a.project))
        case "tsort":
            starts = [full(p) for p in a.paths]
            order = tsort(ix, starts, a.project)
            return shown(order) if order is not None else "There is a cycle among:\n" + shown(cyclic_modules(ix, starts, a.project))
        case "imports":
            return shown(imports(ix, first))
        case "inspect":
            return str(inspect(ix, first))
        case "tscat":
            return tscat(ix, first)
        case "needs":
            return shown(needs(ix, first) or [])
        case "import-chain":
            return shown(import_chain(ix, first, full(a.target)))
        case "project-use":
            return table(project_use(ix, first, full(a.target), a.symbols))
        case "symbol-usage":
            return table(symbol_usage(ix, first, a.symbol))
        case "trace-imports":
            return table(trace_imports(ix, first, full(a.from_project) if a.from_project else None))
        case "grep":
            return table(grep(ix, first, a.symbol, a.usage))
        case "cycles":
            found, edges = cycles(ix, first, a.directories)
            if a.graphviz:
                return render.cycles_dot(found, edges, "DirectoryCycles" if a.directories else "ModuleCycles", cwd)
            if a.ascii or a.fancy:
                return "\n\n".join(render.grid(c, edges, render.BOX if a.fancy else render.ASCII, cwd) for c in found)
            return render.cycles_text(found, cwd, "directories" if a.directories else "modules")
        case "coupling":
            return coupling(ix, first, a.name, a.graphviz, a.shallow)
        case "hot":
            return hot_report(ix, first, full(a.select) if a.select else None)
        case "type-leaf-usage":
            return shown(type_leaf_usage(ix, first, a.types, a.everything))
        case "outline":
            members = lines(f"{m[0]}-{m[1]} {m[2]} {m[5] if a.verbose else m[3]}" for m in outline(ix, first, a.with_imports))
            return f"{outline_summary(ix, first)}\n{members}" if a.verbose else members
        case "mv":
            plan = move(ix, first, full(a.target))
            version_control_move(first, full(a.target))
            model.execute(plan, model.Disk())
            return model.display(plan)
        case "split" | "propose-split":
            plan = propose_split(ix, first, full(a.target), a.symbols)
            if a.command == "split":
                model.execute(plan, model.Disk())
                return model.display(plan)
            return _saved(plan)
        case "replace-type-use":
            plan = replace_type_use(ix, first, a.source_type, a.target_type, a.source_module, a.target_module)
            model.execute(plan, model.Disk())
            return model.display(plan)
        case _:
            return _saved({"propose-import-directly": propose_import_directly, "propose-purge-reexport": propose_purge_reexport, "normalize-imports": normalize_imports, "normalize-namespace-imports": normalize_namespace_imports}[a.command](ix, first))


def main() -> None:
    import os

    spark = SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    print(run(spark, sys.argv[1:], os.getcwd()))


if __name__ == "__main__":
    main()
