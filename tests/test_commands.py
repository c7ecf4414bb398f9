import pytest
from pyspark.sql import functions as F

from modweave import commands as C
from modweave.functions import render, text as T
from modweave.functions.paths import ancestors, display, middle_cut, normalised, rebased, relative_import
from modweave.operators import lookups, resolve
from modweave.sources import files as S
from modweave.sources.store import FactStore, differences, first_difference, read_json_lines, write_json_lines
from modweave.streaming import refresh

REPO = {
    "/r/tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@/*": ["src/*"]}}}',
    "/r/src/a.ts": "import { b } from './b';\nimport { thing } from '@/lib/index';\nexport const a = b + thing;\n",
    "/r/src/b.ts": "import { c } from './c.js';\nexport const b = c;\n",
    "/r/src/c.ts": "import { b } from './b';\nexport const c = process.env.X;\nexport type Shape = string;\n",
    "/r/src/lib/index.ts": "export { thing, unused } from './impl';\n",
    "/r/src/lib/impl.ts": "export const thing = 1;\nexport const unused = 2;\n",
    "/r/src/v.vue": "<template/>\n<script lang=\"ts\">\nimport { a } from './a';\nimport x from 'vue';\nexport const v = a;\n</script>\n",
    "/r/other/tsconfig.json": "{}",
    "/r/other/o.ts": "import { a } from '../src/a';\nimport type { Shape } from '../src/c';\nexport const o: Shape = a;\n",
}


@pytest.fixture(scope="module")
def ix(spark):
    return C.index(S.in_memory(spark, REPO), "/r")


def test_facts(ix):
    rows = {(r["importer_path"], r["symbol_name"]): (r["exporter_path"], r["exporter_spec"]) for r in ix.imports.collect()}
    assert rows["/r/src/a.ts", "b"] == ("/r/src/b.ts", None)
    assert rows["/r/src/a.ts", "thing"] == ("/r/src/lib/index.ts", None)
    assert rows["/r/src/b.ts", "c"] == ("/r/src/c.ts", None)
    assert rows["/r/src/v.vue", "default"] == (None, "vue")
    assert rows["/r/other/o.ts", "a"] == ("/r/src/a.ts", None)


def test_queries(ix):
    assert C.imports(ix, "/r/src/a.ts") == ["/r/other/o.ts", "/r/src/v.vue"]
    assert C.dependencies(ix, ["/r/src/a.ts"])[-1] == "/r/src/a.ts"
    assert set(C.dependencies(ix, ["/r/src/a.ts"])) == {"/r/src/a.ts", "/r/src/b.ts", "/r/src/c.ts", "/r/src/lib/index.ts"}
    assert "/r/src/a.ts" not in C.dependencies(ix, ["/r/other/o.ts"], project=True)
    assert C.cycles(ix, "/r")[0] == [["/r/src/b.ts", "/r/src/c.ts"]]
    assert C.needs(ix, "/r/src/a.ts") == ["/r/src/a.ts", "/r/src/b.ts", "/r/src/c.ts"]
    assert C.needs(ix, "/r/src/lib/index.ts") is None
    assert C.tsort(ix, ["/r/src/a.ts"]) is None
    assert C.tsort(ix, ["/r/src/lib/index.ts"]) == ["/r/src/lib/index.ts"]
    assert C.import_chain(ix, "/r/src/v.vue", "/r/src/lib/index.ts") == ["/r/src/v.vue", "/r/src/a.ts", "/r/src/lib/index.ts"]
    assert [tuple(r) for r in C.project_use(ix, "/r/other/tsconfig.json", "/r/tsconfig.json").orderBy("exporter_path").collect()] == [("/r/src/a.ts", ["/r/other/o.ts"]), ("/r/src/c.ts", ["/r/other/o.ts"])]
    assert [r[0] for r in C.grep(ix, "/r/src", "thing").collect()] == ["/r/src/lib/index.ts"]
    assert C.type_leaf_usage(ix, "/r", ["Shape"]) == ["/r/other/o.ts"]
    assert C.inspect(ix, "/r/src/c.ts")["node_globals"] == [{"identifier": "process", "line": 2, "column": 18}]
    assert "import { a }" in C.tscat(ix, "/r/src/v.vue")
    assert [m[3] for m in C.outline(ix, "/r/src/c.ts")] == ["c", "Shape"]
    assert "Top 10" in C.hot_report(ix, "/r")
    assert "Dependents -> Dependencies" in C.coupling(ix, "/r/src/c.ts")


def test_commands_over_files_folders_and_packages(ix):
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(C.trace_imports(ix, "/r/src/a.ts")) == [("/r/src/b.ts", ["b"]), ("/r/src/lib/index.ts", ["thing"])]
    assert rows(C.trace_imports(ix, "/r/other")) == rows(C.trace_imports(ix, "/r/other/o.ts")) == [("/r/src/a.ts", ["a"]), ("/r/src/c.ts", ["Shape"])]
    assert rows(C.trace_imports(ix, "/r/src/a.ts", "/r/src/lib")) == [("/r/src/lib/index.ts", ["thing"])]
    assert rows(C.symbol_usage(ix, "/r/src", "a")) == rows(C.symbol_usage(ix, "/r/tsconfig.json", "a")) == [("/r/src/a.ts", "/r/other/o.ts"), ("/r/src/a.ts", "/r/src/v.vue")]
    assert rows(C.symbol_usage(ix, "/r/other", "a")) == []
    assert C.type_leaf_usage(ix, "/r/src", ["default"]) == ["/r/src/v.vue"]  # from a package
    assert C.cyclic_modules(ix, ["/r/src/a.ts"]) == ["/r/src/b.ts", "/r/src/c.ts"]
    assert C.import_chain(ix, "/r/src/b.ts", "/r/src/c.ts") == ["/r/src/b.ts", "/r/src/c.ts"]
    assert C.outline_summary(ix, "/r/src/a.ts").split("\n")[1].startswith("Summary: 2 import")
    assert rows(lookups.imports_from(ix.imports, "/r/src/v.vue").select("symbol_name", "exporter_path")) == [("a", "/r/src/a.ts"), ("default", None)]
    assert {r["path"] for r in lookups.reexports_named(ix.tables["reexports"], "unused").collect()} == {"/r/src/lib/index.ts"}
    assert lookups.reexports_of(ix.tables["reexports"], "/r/src/lib/index.ts").count() == 2


def test_scripts_in_markup_are_edited_in_place(spark):
    page = "<template>\n  <p>`not code` import x from './c'</p>\n</template>\n<script lang=\"ts\">\nimport { c } from './c';\nimport { thing } from './lib';\nexport const v = c + thing;\n</script>\n<style>a{}</style>\n"
    ix = C.index(S.in_memory(spark, REPO | {"/r/src/page.vue": page}), "/r")
    moved = {c.path: c for c in C.move(ix, "/r/src/c.ts", "/r/src/deep/c.ts").changes}
    assert moved["/r/src/page.vue"].content == page.replace("{ c } from './c'", "{ c } from './deep/c'")
    direct = {c.path: c for c in C.propose_import_directly(ix, "/r").changes}
    assert direct["/r/src/page.vue"].content == page.replace("'./lib'", "'./lib/impl'")


def test_version_control_hears_of_moves(spark, tmp_path):
    import subprocess

    for p, t in REPO.items():
        (tmp_path / p[1:]).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p[1:]).write_text(t)
    root = str(tmp_path / "r")
    git = lambda *a: subprocess.run(["git", "-C", root, *a], capture_output=True, text=True, check=True).stdout
    git("init", "-q")
    git("add", "-A")
    git("-c", "user.name=n", "-c", "user.email=e@x", "commit", "-qm", "first")
    C.run(spark, ["mv", "src/c.ts", "src/deep/c.ts"], root)
    assert "R  src/c.ts -> src/deep/c.ts" in git("status", "--porcelain").replace("RM", "R ")
    assert (tmp_path / "r/src/deep/c.ts").read_text().startswith("import { b } from '../b';")
    assert not (tmp_path / "r/src/c.ts").exists()


def test_relative_fallback_inside_a_project(spark):
    configs = spark.createDataFrame([("/r/tsconfig.json", {"@/*": ["src/*"]}, None, None)], "path string, paths map<string,array<string>>, base_url string, root_dir string")
    uses = [("/r/src/q.ts", "/r/lib/a.ts"), ("/r/lib/x/q.ts", "/r/lib/a.ts"), ("/r/top.ts", "/r/lib/x/a.ts"), ("/z/q.ts", "/r/lib/a.ts")]
    got = resolve.specifier_for(spark.createDataFrame([(p, i, "/r/tsconfig.json") for p, i in uses], "path string, importer_path string, tsconfig string"), configs)
    assert {(r["path"], r["importer_path"]): r["spec"] for r in got.collect()} == dict(zip(uses, ["@/q", "./x/q", "../../top", None], strict=True))


def test_proposals(ix):
    direct = C.propose_import_directly(ix, "/r")
    assert [(c.path, c.content.split("\n")[1]) for c in direct.changes] == [("/r/src/a.ts", "import { thing } from './lib/impl';")]
    purge = C.propose_purge_reexport(ix, "/r")
    assert [(c.path, c.content) for c in purge.changes] == [("/r/src/lib/index.ts", "export { thing } from './impl';\n")]
    moved = C.move(ix, "/r/src/c.ts", "/r/src/deep/c.ts")
    by = {c.path: c for c in moved.changes}
    assert by["/r/src/deep/c.ts"].content.startswith("import { b } from '../b';")
    assert by["/r/src/b.ts"].content.startswith("import { c } from './deep/c.js';")
    assert "'../src/deep/c'" in by["/r/other/o.ts"].content
    assert by["/r/src/c.ts"].type == "delete-file"
    replaced = C.replace_type_use(ix, "/r", "Shape", "Form", "./c", "../src/form")
    assert "import type { Form } from '../src/form';" in replaced.changes[0].content


def test_store_refresh_replaces_and_evicts(spark, tmp_path):
    store = FactStore(spark, str(tmp_path / "store"))

    def load(files, time):
        rows = S.in_memory(spark, {p: t for p, t in files.items()}, time)
        config_rows = S.configs(S.in_memory(spark, REPO))
        code = rows.filter(F.col("path").rlike(r"\.(ts|vue)$"))
        return {r["path"]: r["state"] for r in store.refresh(code, lambda fresh: S.facts(S.extract(fresh), code, config_rows)).collect()}

    assert set(load(REPO, 1.0).values()) == {"new"}
    assert load(REPO, 1.0) == {}
    n = store.read("imports").count()
    fewer = {p: t for p, t in REPO.items() if p != "/r/src/v.vue"}
    assert load(fewer, 1.0) == {"/r/src/v.vue": "gone"}
    assert store.read("imports").count() == n - 2
    changed = fewer | {"/r/src/lib/index.ts": "export { thing } from './impl';\n"}
    assert load(changed, 0.5)["/r/src/lib/index.ts"] == "changed"  # an earlier time counts too
    assert store.read("reexports").count() == 1


def test_streamed_refresh(spark, tmp_path):
    store, folder = FactStore(spark, str(tmp_path / "store")), str(tmp_path / "in")
    config_rows = S.configs(S.in_memory(spark, REPO))
    code = {p: t for p, t in REPO.items() if not p.endswith(".json")}
    S.in_memory(spark, code, 1.0).write.parquet(folder)
    refresh.start(spark, folder, store, config_rows, str(tmp_path / "cp")).awaitTermination()
    assert {r[0] for r in lookups.importers_of(store.read("imports"), "/r/src/a.ts").collect()} == {"/r/other/o.ts", "/r/src/v.vue"}
    S.in_memory(spark, {"/r/other/o.ts": "export const o = 1;\n"}, 2.0).write.mode("append").parquet(folder)
    refresh.start(spark, folder, store, config_rows, str(tmp_path / "cp")).awaitTermination()
    assert {r[0] for r in lookups.importers_of(store.read("imports"), "/r/src/a.ts").collect()} == {"/r/src/v.vue"}


def test_disk_scan_and_command_line(spark, tmp_path):
    for p, t in REPO.items():
        (tmp_path / p[1:]).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p[1:]).write_text(t)
    for skipped in ("r/.git/x.ts", "r/node_modules/m/i.ts", "r/src/_private/p.ts", "r/src/.hidden.ts"):
        (tmp_path / skipped).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / skipped).write_text("export const x = 1;")
    root = str(tmp_path / "r")
    assert {r[0] for r in S.scan(spark, root).select("path").collect()} == {str(tmp_path / p[1:]) for p in REPO if not p.endswith(".json")}
    assert C.run(spark, ["imports", "src/a.ts"], root) == "other/o.ts\nsrc/v.vue"
    assert "src/b.ts" in C.run(spark, ["cycles", "."], root)
    assert C.run(spark, ["cycles", ".", "--graphviz"], root).startswith("digraph ModuleCycles")
    assert C.run(spark, ["tsort", "src/a.ts"], root) == "There is a cycle among:\nsrc/b.ts\nsrc/c.ts"
    assert C.run(spark, ["trace-imports", "other/o.ts"], root).split("\n")[0].endswith("src/a.ts\ta")
    assert C.run(spark, ["outline", "src/a.ts", "--verbose"], root).startswith("# src/a.ts\nSummary: 2 import, ")


def test_resolution(spark):
    files = spark.createDataFrame([("/r/src/lib/index.ts",), ("/r/src/a.ts",), ("/r/a.ts",)], "path string")
    configs = spark.createDataFrame([("/r/tsconfig.json", {"@/*": ["src/*"]}, None, None)], "path string, paths map<string,array<string>>, base_url string, root_dir string")
    rows = [("/r/src/a.ts", "/r/tsconfig.json", s) for s in ("./lib", "../a", "@/a", "./x.js", "./y.mjs", "./no/z", "pkg", "./w.vue")]
    got = {r["spec"]: r["exporter_path"] for r in resolve.resolve_specifiers(spark.createDataFrame(rows, "path string, tsconfig string, spec string"), files, configs).collect()}
    assert got == {"./lib": "/r/src/lib/index.ts", "../a": "/r/a.ts", "@/a": "/r/src/a.ts", "./x.js": "/r/src/x.ts", "./y.mjs": "/r/src/y.mts", "./no/z": None, "pkg": None, "./w.vue": "/r/src/w.vue.ts"}
    specs = resolve.specifier_of(spark.createDataFrame([("/r/src/lib/q.ts", "/r/tsconfig.json"), ("/z.ts", "/r/tsconfig.json")], "path string, tsconfig string"), configs)
    assert {r["path"]: r["spec"] for r in specs.collect()} == {"/r/src/lib/q.ts": "@/lib/q", "/z.ts": None}


def test_text_functions(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} string" for k in v)).select(c).first()[0]
    vue = "<a/><script setup>\nlet x;\n</script><b/>"
    assert one(T.script_of("h"), h=vue) == "\nlet x;\n"
    assert one(T.script_of("h"), h="<a/>") == ""
    assert one(T.script_of("h"), h="<script>x") is None
    assert one(T.with_script("h", "s"), h=vue, s="y") == "<a/><script setup>\ny</script><b/>"
    assert one(T.checked_script("h"), h=vue) == "\nlet x;\n"
    with pytest.raises(Exception, match="put back"):
        one(T.checked_script("h"), h="<script>x</script>")
    assert one(T.fewer_blank_lines("h"), h="a\n\n\n\nb") == "a\n\nb"
    assert one(T.dot_quoted("h"), h='a"b\\') == '"a\\"b\\\\"'
    assert one(T.pattern_quoted("h"), h="a.b") == "a\\.b"
    assert one(T.is_generated("h"), h="/* x\n @generated */")
    assert not one(T.is_generated("h"), h="'@generated'")
    assert one(normalised("h"), h="/a/./b/../c//d") == "/a/c/d"
    assert one(ancestors("h"), h="/a/b/c.ts") == ["", "/a", "/a/b"]


def test_path_functions():
    assert relative_import("/a/b/c.ts", "/a/d.ts") == "../d"
    assert rebased("./x", "/a/b.ts", "/a/c/b.ts") == "../x"
    assert display("/r/src/a.ts", "/r") == "src/a.ts"
    assert display("/x.ts", "/a/b/c/d") == "/x.ts"
    assert middle_cut("abcdefghij", 7) == "ab...ij"


def test_store_helpers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "path string, mtime_ms double")
    write_json_lines(df, str(tmp_path / "j"))
    back = read_json_lines(spark, str(tmp_path / "j"), "path string, mtime_ms double")
    assert differences(df, back).isEmpty()
    assert differences(df, back.limit(1)).count() == 1
    assert first_difference({"a": [1, {"b": 2}]}, {"a": [1, {"b": 3}]}) == "/a/1/b: 2 and 3"
    assert first_difference({"a": None}, {"a": None}) is None
    with pytest.raises(TypeError):
        first_difference(object(), 1)


def test_reports():
    cycle, edges = ["/a.ts", "/b.ts", "/c.ts"], {("/a.ts", "/b.ts"), ("/b.ts", "/c.ts"), ("/c.ts", "/a.ts")}
    assert "Cycle 1 (3 modules)" in render.cycles_text([cycle])
    assert render.cycles_dot([cycle], edges).count("->") == 3
    art = render.grid(cycle, edges).split("\n")
    assert [art[2 * i][3 * i] for i in range(3)] == ["o"] * 3
    assert render.cycles_text([]).startswith("No import cycles")
    dot = render.coupling_dot(["x", "y"], {("x", "y")})
    assert '"#d9f99d"' in dot
    assert '"#bfdbfe"' in dot
    assert "\x1b[38;2;" in render.chain_text([("/a", 5.0)], 0.0, 2.0, 9.0)
