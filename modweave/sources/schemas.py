"""Schemas of the fact tables and of a change plan."""

from __future__ import annotations

FILES = "path string, mtime_ms double, content string"
IMPORTS = "importer_path string, importer_tsconfig string, import_index int, symbol_name string, exporter_path string, exporter_tsconfig string, exporter_spec string"
REEXPORTS = "path string, reexport_index int, symbol_name string, module_spec string, is_type_only boolean"
EXPORTS = "path string, symbol_name string"
NEEDS = "path string, nodejs boolean"
FILE_TIMES = "path string, mtime_ms double"
CONFIGS = "path string, paths map<string,array<string>>, base_url string, root_dir string"
SYMBOL_EDGES = "path string, src string, dst string"

_CHANGE = "array<struct<type:string,path:string,content:string,originalChecksum:string>>"
PLAN = f"version string, command string, timestamp string, sourceFiles array<string>, targetFiles array<string>, checksums map<string,string>, changes {_CHANGE}, undo {_CHANGE}"

#: Fact tables that are kept by path: name, schema, and the column that holds the path.
FACTS = {
    "imports": (IMPORTS, "importer_path"),
    "reexports": (REEXPORTS, "path"),
    "exports": (EXPORTS, "path"),
    "module_needs": (NEEDS, "path"),
    "file_times": (FILE_TIMES, "path"),
}
