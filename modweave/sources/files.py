"""Source files as rows, and the facts extracted from them."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from modweave.functions.text import source_text
from modweave.functions.typescript import Module, is_generated
from modweave.operators.resolve import nearest_config, resolve_specifiers
from modweave.sources.schemas import CONFIGS

#: What the extractor gives for each file: one wide row, exploded into tables below.
WIDE = (
    "path string, generated boolean, imports array<struct<local:string,name:string,spec:string,type_only:boolean>>, "
    "reexports array<struct<name:string,spec:string,type_only:boolean>>, exports array<string>, "
    "node_globals array<struct<identifier:string,line:int,column:int>>, "
    "definitions array<struct<name:string,kind:string,exported:boolean,start:int,end:int,line:int,end_line:int,signature:string>>, "
    "uses array<struct<symbol:string,used:string>>, accumulated array<struct<symbol:string,import_name:string>>, "
    "members array<string>, member_edges array<struct<src:string,dst:string>>"
)


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime_ms, content) of ``.ts`` and ``.vue`` files below ``root``.

    Below the root, names that begin with a dot or underscore and ``node_modules`` are skipped.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{ts,vue}").load(root)
    path = F.regexp_replace("path", "^file:/+", "/")
    below = F.expr(f"substring(regexp_replace(path, '^file:/+', '/'), {len(root.rstrip('/')) + 1})")
    return found.filter(~below.rlike(r"/([._][^/]*|node_modules)(/|$)")).select(path.alias("path"), (F.col("modificationTime").cast("double") * 1000).alias("mtime_ms"), F.col("content").cast("string").alias("content"))


def in_memory(spark: SparkSession, files: dict[str, str], mtime_ms: float = 0.0) -> DataFrame:
    """Files given as texts."""
    return spark.createDataFrame([(p, mtime_ms, t) for p, t in files.items()], "path string, mtime_ms double, content string")


def parse_config(text: str) -> tuple[dict[str, list[str]], str | None, str | None]:
    """(paths, base URL, root folder) of a configuration with comments and trailing commas."""
    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    plain = re.sub(r'("(?:\\.|[^"\\])*")|,(?=\s*[}\]])', lambda m: m[1] or "", plain)
    options = json.loads(plain or "{}").get("compilerOptions") or {}
    return options.get("paths") or {}, options.get("baseUrl"), options.get("rootDir")


def configs(files: DataFrame) -> DataFrame:
    """(path, paths, base_url, root_dir) of the files named ``tsconfig.json``."""

    def run(frames):
        for f in frames:
            read = [parse_config(t) for t in f["content"]]
            yield pd.DataFrame({"path": f["path"], "paths": [r[0] for r in read], "base_url": [r[1] for r in read], "root_dir": [r[2] for r in read]})

    return files.filter(F.col("path").endswith("/tsconfig.json")).select("path", "content").mapInPandas(run, CONFIGS)


def module_row(path: str, text: str) -> dict:
    """The wide row of one file."""
    m = Module(text)
    names, edges = m.module_members()
    return {
        "path": path,
        "generated": is_generated(m),
        "imports": [{"local": k, "name": v[1], "spec": v[0], "type_only": v[2]} for k, v in m.imports().items()],
        "reexports": [{"name": n, "spec": s, "type_only": t} for n, s, t in m.reexports()],
        "exports": m.exported(),
        "node_globals": [{"identifier": n, "line": a, "column": b} for n, a, b in m.node_globals()],
        "definitions": [{"name": d.name, "kind": d.kind, "exported": d.exported, "start": d.start, "end": d.end, "line": d.line, "end_line": d.end_line, "signature": d.signature} for d in m.definitions],
        "uses": [{"symbol": s, "used": u} for s, own in sorted(m.uses().items()) for u in sorted(own)],
        "accumulated": [{"symbol": s, "import_name": u} for s, own in sorted(m.accumulated().items()) for u in sorted(own)],
        "members": names,
        "member_edges": [{"src": a, "dst": b} for a, b in sorted(edges)],
    }


def extract(files: DataFrame) -> DataFrame:
    """One wide row (:data:`WIDE`) for each source file; parsing sees nothing but the file's own text."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame([module_row(p, t) for p, t in zip(f["path"], f["text"], strict=True)], columns=[c.split()[0] for c in re.split(r", (?=\w+ (?:array|string|boolean))", WIDE)])

    source = files.filter(F.col("path").rlike(r"\.(ts|vue)$")).select("path", F.coalesce(source_text("path", "content"), F.lit("")).alias("text"))
    return source.mapInPandas(run, WIDE)


def facts(wide: DataFrame, files: DataFrame, config_rows: DataFrame) -> dict[str, DataFrame]:
    """Fact tables of wide rows: imports are resolved against the files and configurations."""
    projects = nearest_config(wide.select("path"), config_rows.select("path"))
    raw = wide.select("path", F.posexplode("imports").alias("import_index", "i")).select("path", "import_index", F.col("i.local").alias("local_name"), F.col("i.name").alias("symbol_name"), F.col("i.spec").alias("spec"), F.col("i.type_only").alias("type_only"))
    resolved = resolve_specifiers(raw.join(projects, "path"), files.select("path"), config_rows)
    to = projects.select(F.col("path").alias("exporter_path"), F.col("tsconfig").alias("exporter_tsconfig"))
    spec = F.when(F.col("exporter_path").isNull(), F.col("spec")).alias("exporter_spec")
    imports = resolved.join(to, "exporter_path", "left").select(F.col("path").alias("importer_path"), F.col("tsconfig").alias("importer_tsconfig"), "import_index", "symbol_name", "exporter_path", "exporter_tsconfig", spec)
    reexports = wide.select("path", F.posexplode("reexports").alias("reexport_index", "r")).select("path", "reexport_index", F.col("r.name").alias("symbol_name"), F.col("r.spec").alias("module_spec"), F.col("r.type_only").alias("is_type_only"))
    return {
        "imports": imports,
        "reexports": reexports,
        "exports": wide.select("path", F.explode("exports").alias("symbol_name")),
        "module_needs": wide.select("path", (F.size("node_globals") > 0).alias("nodejs")),
    }
