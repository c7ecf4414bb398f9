import pytest

from modweave.functions.typescript import Module, has_public_tag, is_generated
from modweave.sources.files import parse_config


def test_imports_by_kind():
    m = Module("import { a, b as c } from './x';\nimport * as ns from './n';\nimport d from 'd';\nimport e, { f } from 'e';\nimport type { T } from './t';\nimport './side';\n")
    assert m.imports() == {"a": ("./x", "a", False), "b": ("./x", "b", False), "ns": ("./n", "*", False), "d": ("d", "default", False), "f": ("e", "f", False), "T": ("./t", "T", True)}


def test_reexports_mark_names_as_exported():
    m = Module("export { a, type B } from './x';\nexport * from './y';\nconst z = 1;\nexport { z };\n")
    assert m.reexports() == [("a", "./x", False), ("B", "./x", True)]
    assert m.exported() == ["a", "B"]


def test_uses_of_definitions():
    m = Module("import { dep, Shape } from './d';\nfunction inner(x: number) { return dep(x) }\nexport function outer(s: Shape) { var t = inner(1); return t }\nexport const v: Shape = inner;\n")
    assert m.uses()["outer"] == {"Shape", "inner"}
    assert m.accumulated() == {"outer": {"Shape", "dep"}, "v": {"Shape", "dep"}}


def test_types_in_all_places():
    m = Module("type A = B<C> | (D & E)[] | F['k'] | typeof g | { [K in H]: I } | ((x: J) => L) | { m(n: M): N };\ninterface P extends Q<R> { s: S }\nclass T2 extends U<V> implements W { x: X = y; }\n")
    assert {"B", "C", "D", "E", "F", "g", "H", "I", "J", "L", "M", "N"} <= m.uses()["A"]
    assert m.uses()["P"] == {"Q", "R", "S"}
    assert m.uses()["T2"] == {"U", "V", "W", "X"}


def test_overloads_and_templates():
    m = Module("export function f(a: string): void;\nexport function f(a: number): void;\nexport function f(a: any) { return `${g(a)} and ${`${h}`}` }\nconst r = /[/'\"`]/.test(q);\n")
    assert {"g", "h"} <= m.uses()["f"]
    assert m.uses()["r"] == {"q"}


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("export const b = Buffer.from('x');", ["Buffer"]),
        ("export function f(b: Buffer): Promise<Buffer> { return b as any }", []),
        ("if (typeof process !== 'undefined') { process.exit() }", []),
        ("type P = typeof process;", []),
        ("interface I { process: string; exports(): void }", []),
        ("class C { process() { return 1 } }", []),
        ("const x = obj.global;", []),
        ("declare global { interface Window { a: string } }", []),
        ("const e = process.env.HOME;", ["process"]),
        ("const d = __dirname + require('x');", ["__dirname", "require"]),
        ("const o = { exports: 1, module: 2 };", []),
    ],
)
def test_runtime_globals(text, found):
    assert [g[0] for g in Module(text).node_globals()] == found


def test_globals_have_positions():
    assert Module("const a = 1;\n  process.exit();\n").node_globals() == [("process", 2, 3)]


def test_class_members():
    m = Module("class A { private a = 1; b = this.a; constructor() { this.init() } init(): void { this.c() } c = () => this.d; get d() { return 1 } e() { function g() { return this.a } return g } }")
    members, edges = m.class_members("A")
    assert set(members) == {"a", "b", "constructor", "init", "c", "d", "e"}
    assert edges == {("b", "a"), ("constructor", "init"), ("init", "c"), ("c", "d")}


def test_module_members_leave_shadowed_names_out():
    m = Module("const a = 1;\nconst { p, q: [r] } = a;\nfunction f(a) { return a + p }\nclass K { x = r; static { f(1) } }\ninterface I { a: string }\n")
    members, edges = m.module_members()
    assert members == ["a", "p", "r", "f", "K", "I"]
    assert edges == {("p", "a"), ("r", "a"), ("f", "p"), ("K", "r"), ("K", "f")}


def test_outline_and_markers():
    text = "/* @generated */\nimport { a, b, c, d } from './x';\n/** @public */\nexport { a } from './y';\nexport function f(x: number): string {\n  return '';\n}\n"
    m = Module(text)
    assert [r[2:4] for r in m.outline()] == [("import", "./x"), ("export", "./y"), ("function", "f")]
    assert m.outline()[0][5] == "a, b, c, +1 more"
    assert m.outline()[2][:2] == (5, 7)
    assert is_generated(m)
    assert has_public_tag(m, text.index("export"))
    assert not has_public_tag(m, text.index("export function"))
    assert not is_generated(Module("const s = '@generated';"))


def test_configuration_with_comments():
    assert parse_config('{ // c\n "compilerOptions": { "baseUrl": ".", "paths": { "@/*": ["src/*"], }, /* x */ } }') == ({"@/*": ["src/*"]}, ".", None)


@pytest.mark.parametrize("text", ["", "}", "{", "`${", "import", "export {", "class", "type X", "const = ;", "function", "'open", "a ? b : c", "<T,>() => {}"])
def test_broken_text_does_not_crash(text):
    m = Module(text)
    m.node_globals(), m.accumulated(), m.module_members(), m.outline()
