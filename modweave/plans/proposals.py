"""Plans from facts: which files an operation changes is relational, how each text changes is not.

Every proposal is a join that gives (path, what to do); the texts of those files alone are then
edited on the executors, a file at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from modweave.functions.paths import relative_import
from modweave.functions.text import source_text, with_script
from modweave.operators.lookups import unused_reexports
from modweave.plans import rewrites
from modweave.plans.model import Change, Plan, now, plan_of_edits, text_checksum

EDITS = "path string, old string, new string"


def _edited(rows: DataFrame, run, columns: list[str]) -> DataFrame:
    """(path, old, new) of files whose text changes; ``run`` takes the text and the columns.

    Of a ``.vue`` file only the script is edited, and put back into its markup.
    """

    def each(frames):
        for f in frames:
            new = [None if values[0] is None else run(*values) for values in zip(f["script"], *(f[c] for c in columns), strict=True)]
            out = pd.DataFrame({"path": f["path"], "old": f["content"], "new": new})
            yield out[out["new"].notna() & (out["new"] != f["script"])]

    edited = rows.select("path", "content", source_text("path", "content").alias("script"), *columns).mapInPandas(each, EDITS)
    whole = F.when(F.col("path").endswith(".vue"), with_script("old", "new")).otherwise(F.col("new"))
    return edited.select("path", "old", whole.alias("new"))


def _in(files: DataFrame, folder: str) -> DataFrame:
    return files.filter(F.col("path").startswith(folder.rstrip("/") + "/") & F.col("path").endswith(".ts"))


def normalize_imports(files: DataFrame, folder: str) -> DataFrame:
    return _edited(_in(files, folder), rewrites.normalize_imports, [])


def normalize_namespaces(files: DataFrame, folder: str) -> DataFrame:
    return _edited(_in(files, folder), lambda t: rewrites.namespace_to_named(t)[0], [])


def replace_type_use(files: DataFrame, folder: str, old: str, new: str, source: str, target: str) -> DataFrame:
    return _edited(_in(files, folder).filter(F.col("content").contains(old)), lambda t: rewrites.replace_type(t, old, new, source, target), [])


def purge_reexports(files: DataFrame, imports: DataFrame, reexports: DataFrame) -> DataFrame:
    """Re-exports without importers, by name or namespace; of the whole repository, as the operation always was."""
    unused = unused_reexports(imports, reexports).groupBy("path").agg(F.collect_set("symbol_name").alias("names"))
    return _edited(files.join(unused, "path"), lambda t, names: rewrites.purge_reexports(t, set(names)), ["names"])


def import_directly(files: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates have importer_path, spec (as written), symbol_name and original_path; one hop a run."""
    by = candidates.select(F.col("importer_path").alias("path"), F.struct("spec", "symbol_name", "original_path").alias("c")).groupBy("path").agg(F.collect_set("c").alias("moves"))
    rows = files.join(by, "path").withColumn("own", F.col("path"))
    return _edited(rows, lambda t, own, moves: rewrites.import_directly(t, {(m["spec"], m["symbol_name"]): relative_import(own, m["original_path"]) for m in moves}), ["own", "moves"])


def move_file(files: DataFrame, imports: DataFrame, old: str, new: str) -> DataFrame:
    """Edits of all importers of a moved file, and of the file itself (under its old path)."""
    importers = imports.filter(F.col("exporter_path") == old).select(F.col("importer_path").alias("path")).distinct()
    others = _edited(files.join(importers, "path", "left_semi").filter(F.col("path") != old).withColumn("own", F.col("path")), lambda t, own: rewrites.repoint(t, own, old, new), ["own"])
    return others.unionByName(_edited(files.filter(F.col("path") == old), lambda t: rewrites.respecify(t, old, new), []))


def plan(command: str, edits: DataFrame) -> Plan:
    """The plan of an operation's edits, which are what a person reviews."""
    return plan_of_edits(command, {r["path"]: (r["old"], r["new"]) for r in edits.collect()})


def propose_split(source_file: str, text: str, target_file: str, symbols: list[str]) -> Plan:
    """The plan that moves symbols to a new module, with its undo."""
    source, target = rewrites.split(text, source_file, target_file, symbols)
    total = text_checksum(text)
    changes = [Change("create-file", target_file, target), Change("modify-file", source_file, source, total)]
    back = [Change("modify-file", source_file, text), Change("delete-file", target_file)]
    return Plan("propose-split", changes, {source_file: total}, [source_file], [target_file], back, timestamp=now())
