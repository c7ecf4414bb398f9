"""Facts of one TypeScript module: imports, exports, uses, definitions, runtime globals, members."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from modweave.functions.tokens import STATEMENTS, Comment, Roles, Token, tokenize

# The names whose use needs the Node.js runtime.
NODE_GLOBALS = ["Buffer", "process", "__dirname", "__filename", "global", "require", "module", "exports", "__esModule"]


@dataclass
class Name:
    """An imported or exported name of a declaration."""

    name: str
    local: str
    type_only: bool
    start: int
    end: int


@dataclass
class Declaration:
    """An import or re-export declaration with its span."""

    kind: str  # import or export
    spec: str | None
    type_only: bool
    default: str | None
    namespace: str | None
    names: list[Name]
    start: int
    end: int
    spec_start: int = 0
    spec_end: int = 0
    star: bool = False
    comments: list[str] = field(default_factory=list)


@dataclass
class Definition:
    """A top-level definition; ``first`` and ``last`` are token indices."""

    name: str
    kind: str  # function, class, interface, type, variable, enum, namespace
    exported: bool
    start: int
    end: int
    first: int
    last: int
    line: int = 0
    end_line: int = 0
    default: bool = False
    uses: set[str] = field(default_factory=set)
    signature: str = ""


class Module:
    """One parsed source text."""

    def __init__(self, text: str):
        self.text = text
        self.tokens, self.comments = tokenize(text)
        Roles(self.tokens)
        self.declarations: list[Declaration] = []
        self.definitions: list[Definition] = []
        self.local_exports: list[str] = []
        at = 0
        while at < len(self.tokens):
            end = self._statement_end(at)
            self._statement(at, end)
            at = end

    # Statements

    def _ends_line(self, i: int) -> bool:
        """Whether a statement may end between the tokens i - 1 and i, which are on different lines."""
        a, b = self.tokens[i - 1], self.tokens[i]
        if a.kind == "p" and a.text not in (")", "]", "}", "++", "--", ">", "!", ";") or a.text in ("=", "extends", "typeof", "as", "return", "from", "import", "export", "const", "let", "var", "type"):
            return False
        return b.kind in ("id", "str", "num", "template") and b.text not in ("as", "in", "of", "instanceof", "extends", "implements", "is", "satisfies", "from") or b.text in ("@", "{", "}") and b.kind == "p"

    def _statement_end(self, at: int) -> int:
        t, i = self.tokens, at
        word = next((t[k].text for k in range(at, min(at + 5, len(t))) if t[k].text not in ("export", "default", "declare", "abstract", "async")), "")
        body = word in ("function", "class", "interface", "enum", "namespace", "module", "global", "if", "for", "while", "try", "switch", "do") or word == "const" and any(t[k].text == "enum" for k in range(at, min(at + 4, len(t))))
        while i < len(t):
            if t[i].kind == "p" and t[i].text == ";":
                return i + 1
            if t[i].kind == "p" and t[i].text in ("(", "[", "{", "${") and t[i].match > i:
                brace = t[i].text == "{"
                i = t[i].match + 1
                if body and brace and not (i < len(t) and t[i].text in ("else", "catch", "finally", "while", "{") or word == "class" and i < len(t) and t[i].text in ("extends", "implements") or word == "function" and i < len(t) and t[i].text in ("|", "&", "[", ")")):
                    return i
            else:
                i += 1
            if i < len(t) and i > at and t[i].fresh and self._ends_line(i) and not (body and t[i].text == "{"):
                return i
        return i

    def _statement(self, at: int, end: int) -> None:
        t = self.tokens
        i, exported, default = at, False, False
        while i < end and t[i].text in ("export", "default", "declare", "abstract", "async") and not (t[i].text == "async" and t[i + 1].text != "function"):
            exported |= t[i].text == "export"
            default |= t[i].text == "default"
            i += 1
        if i >= end:
            return
        word = t[i].text
        if word == "import" and not exported and t[min(i + 1, end - 1)].text not in ("(", "."):
            self._import(at, end)
        elif exported and (word in ("{", "*") or word == "type" and i + 1 < end and t[i + 1].text in ("{", "*")):
            self._export(at, i, end)
        elif word in ("function", "class", "interface", "enum", "namespace", "module", "type") or word == "const" and i + 1 < end and t[i + 1].text == "enum":
            k = i + 1 + (word == "const")
            k += k < end and t[k].text == "*"
            if k < end and t[k].kind == "id" and t[k].role in ("bind", "prop", "key"):
                self._define(t[k].text, "enum" if word == "const" else word, exported, default, at, end, at, end)
            elif default:
                self._define("default", word, True, True, at, end, at, end)
        elif word in ("const", "let", "var"):
            self._variables(i + 1, at, end, exported)
        elif default:
            self._define("default", "default", True, True, at, end, at, end)

    def _define(self, name, kind, exported, default, at, end, first, last) -> None:
        t = self.tokens
        own = t[first:last]
        uses = {x.text for x in own if x.role in ("value", "type", "query") and not (kind in ("class", "interface") and x.role == "value" and kind == "interface")}
        if kind == "class":  # bodies of classes add no value references
            uses = {x.text for x in own if x.role in ("type", "query") or x.role == "value" and x.depth == t[first].depth}
        if kind == "function":
            uses -= {x.text for x in own if x.role == "bind" and x.depth > t[first].depth}
        head = self.text[t[at].start : t[end - 1].end]
        self.definitions.append(Definition(name, kind, exported, t[at].start, t[end - 1].end, first, last, t[at].line, t[end - 1].line, default, uses - {name} if kind != "function" else uses, _signature(head, kind)))

    def _variables(self, i: int, at: int, end: int, exported: bool) -> None:
        t, depth = self.tokens, self.tokens[i - 1].depth
        first, names = i, []
        for k in range(i, end + 1):
            cut = k == end or t[k].depth == depth and t[k].text in (",", ";")
            if cut:
                eq = next((j for j in range(first, k) if t[j].depth == depth and t[j].text == "="), k)
                names = [x.text for x in t[first:eq] if x.role == "bind"]
                for name in names:
                    self._define(name, "variable", exported, False, at, end, first, k)
                first = k + 1

    def _comments_before(self, at: int) -> list[str]:
        """Comments between the statement before the token and it, each on lines of their own."""
        begin = self.tokens[at - 1].end if at else 0
        return [c.text for c in self.comments if begin <= c.start < self.tokens[at].start and "\n" in self.text[begin : c.start] + ("\n" if not at else "")]

    def _names(self, i: int, end: int, type_only: bool) -> tuple[list[Name], int]:
        t, out, stop = self.tokens, [], self.tokens[i].match
        k = i + 1
        while k < stop:
            e = next((j for j in range(k, stop) if t[j].text == ","), stop)
            own = t[k:e]
            if own:
                single = len(own) > 1 and own[0].text == "type" and own[1].text != "as"
                words = [x.text for x in own[single:]]
                out.append(Name(words[0], words[2] if len(words) > 2 else words[0], type_only or single, own[0].start, own[-1].end))
            k = e + 1
        return out, stop + 1

    def _import(self, at: int, end: int) -> None:
        t, i = self.tokens, at + 1
        type_only = i + 1 < end and t[i].text == "type" and t[i + 1].text not in ("from", ",")
        i += type_only
        d = Declaration("import", None, type_only, None, None, [], t[at].start, t[end - 1].end, comments=self._comments_before(at))
        while i < end:
            if t[i].kind == "str":
                d.spec, d.spec_start, d.spec_end = t[i].text[1:-1], t[i].start, t[i].end
            elif t[i].text == "{":
                d.names, i = self._names(i, end, type_only)
                continue
            elif t[i].text == "*" and i + 2 < end:
                d.namespace = t[i + 2].text
                i += 2
            elif t[i].kind == "id" and t[i].text != "from":
                d.default = t[i].text
            i += 1
        self.declarations.append(d)

    def _export(self, at: int, i: int, end: int) -> None:
        t = self.tokens
        type_only = t[i].text == "type"
        i += type_only
        d = Declaration("export", None, type_only, None, None, [], t[at].start, t[end - 1].end, star=t[i].text == "*", comments=self._comments_before(at))
        if t[i].text == "{":
            d.names, i = self._names(i, end, type_only)
        for k in range(i, end):
            if t[k].kind == "str":
                d.spec, d.spec_start, d.spec_end = t[k].text[1:-1], t[k].start, t[k].end
        if d.spec is None:
            self.local_exports += [n.local for n in d.names]
        self.declarations.append(d)

    # Facts

    def imports(self) -> dict[str, tuple[str, str, bool]]:
        """Local name -> (module, imported name or ``*`` or ``default``, type only).

        A declaration with named bindings does not give its default; an alias counts under its
        original name; side-effect imports give nothing.
        """
        out: dict[str, tuple[str, str, bool]] = {}
        for d in self.declarations:
            if d.kind != "import" or d.spec is None:
                continue
            if d.namespace:
                out[d.namespace] = (d.spec, "*", d.type_only)
            elif d.names:
                out.update({n.name: (d.spec, n.name, d.type_only) for n in d.names})
            elif d.default:
                out[d.default] = (d.spec, "default", d.type_only)
        return out

    def reexports(self) -> list[tuple[str, str, bool]]:
        """(name, module, type only) of ``export {..} from``; stars are left out."""
        return [(n.name, d.spec, n.type_only) for d in self.declarations if d.kind == "export" and d.spec is not None for n in d.names]

    def exported(self) -> list[str]:
        """Names that the module exports by definitions of the handled kinds or re-exports, in order."""
        own = [d.name for d in self.definitions if d.exported and not d.default and d.kind in ("function", "class", "interface", "type", "variable")]
        return list(dict.fromkeys([*own, *(n for n, _, _ in self.reexports())]))

    def uses(self) -> dict[str, set[str]]:
        """Definition -> names that it refers to."""
        out: dict[str, set[str]] = {}
        for d in self.definitions:
            if d.kind in ("function", "class", "interface", "type", "variable"):
                out.setdefault(d.name, set()).update(d.uses)
        return out

    def accumulated(self) -> dict[str, set[str]]:
        """Exported name -> imported names that it needs over any chain of local uses (complete within cycles too)."""
        uses, known = self.uses(), self.imports()
        out = {}
        for name in self.exported():
            seen, stack = set(), [name]
            while stack:
                for used in uses.get(stack.pop(), ()):
                    if used not in seen:
                        seen.add(used)
                        stack.append(used)
            out[name] = {s for s in seen if s in known}
        return out

    def node_globals(self) -> list[tuple[str, int, int]]:
        """(name, line, column) of uses as values, outside ``if (typeof name ...)`` statements."""
        t, guarded = self.tokens, []
        for i, x in enumerate(t):
            if x.text == "if" and i + 1 < len(t) and t[i + 1].text == "(":
                names = {t[k + 1].text for k in range(i + 2, t[i + 1].match) if t[k].text == "typeof"}
                if names:
                    guarded.append((i, self._branch_end(t[i + 1].match + 1), names))
        out = []
        for i, x in enumerate(t):
            if x.kind == "id" and x.role == "value" and x.text in NODE_GLOBALS and not (i and t[i - 1].text == "typeof"):
                if not any(a <= i < b and x.text in names for a, b, names in guarded):
                    out.append((x.text, x.line, x.column))
        return out

    def _branch_end(self, at: int) -> int:
        """After an if's statement and its else."""
        t = self.tokens
        while True:
            if at < len(t) and t[at].text == "{":
                at = t[at].match + 1
            else:
                while at < len(t) and t[at].text != ";" and not (t[at].fresh and t[at].text in STATEMENTS):
                    at = t[at].match + 1 if t[at].match > at else at + 1
                at += at < len(t) and t[at].text == ";"
            if at < len(t) and t[at].text == "else":
                at += 1
                if at < len(t) and t[at].text == "if":
                    at = t[at + 1].match + 1
                continue
            return at

    def import_usage(self) -> dict[str, set[str]]:
        """Definition -> imported names that it uses; definitions that use none are left out."""
        known = {n.local for d in self.declarations if d.kind == "import" for n in d.names} | {x for d in self.declarations if d.kind == "import" for x in (d.default, d.namespace) if x}
        out = {name: used & known for name, used in self.uses().items()}
        return {k: v for k, v in out.items() if v}

    def all_uses(self, d: Definition) -> set[str]:
        """Every name inside a definition that is used as a value or type, class bodies included, its locals left out."""
        own = self.tokens[d.first : d.last]
        return {x.text for x in own if x.role in ("value", "type", "query")} - {x.text for x in own if x.role == "bind" and x.depth > self.tokens[d.first].depth and d.kind in ("function", "variable")}

    # Members

    def module_members(self) -> tuple[list[str], set[tuple[str, str]]]:
        """Top-level members and the pairs (user, used) where an executable body names another."""
        names = list(dict.fromkeys(d.name for d in self.definitions if d.kind not in ("enum", "namespace", "default")))
        edges = set()
        for d in self.definitions:
            if d.name in names and d.kind in ("function", "class", "variable"):
                own = self.tokens[d.first : d.last]
                shadow = {x.text for x in own if x.role == "bind" and x.depth > self.tokens[d.first].depth}
                edges |= {(d.name, x.text) for x in own if x.role == "value" and x.text in names and x.text != d.name and x.text not in shadow}
        return names, edges

    def class_members(self, name: str) -> tuple[list[str], set[tuple[str, str]]]:
        """Members of a class, and the pairs (user, used) by ``this.used`` outside nested ``function`` scopes and classes."""
        t = self.tokens
        at = next((i for i, x in enumerate(t) if x.text == name and x.role == "bind" and i and t[i - 1].text == "class"), None)
        if at is None:
            raise KeyError(f"no class {name}")
        body = next(i for i in range(at, len(t)) if t[i].text == "{" and t[i].depth == t[at].depth)
        level = t[body].depth + 1
        heads = [i for i in range(body + 1, t[body].match) if t[i].depth == level and t[i].role == "key"]
        members = list(dict.fromkeys(t[i].text for i in heads))
        if any(t[i].text == "constructor" for i in range(body + 1, t[body].match) if t[i].depth == level) and "constructor" not in members:
            members.insert(0, "constructor")
        edges = set()
        for k, i in enumerate(heads):
            end = heads[k + 1] if k + 1 < len(heads) else t[body].match
            j = i
            while j < end:
                x = t[j]
                if x.text in ("function", "class") and x.kind == "id" and t[j - 1].text != ".":
                    open_ = next((m for m in range(j, end) if t[m].text == "{" and t[m].depth == x.depth), None)
                    if open_ is not None:
                        j = t[open_].match + 1
                        continue
                if x.text == "this" and j + 2 < end and t[j + 1].text in (".", "?.") and t[j + 2].text in members and t[j + 2].text != t[i].text:
                    edges.add((t[i].text, t[j + 2].text))
                j += 1
        return members, edges

    def outline(self) -> list[tuple[int, int, str, str, bool, str]]:
        """(line, end line, type, name, exported, signature) of imports, definitions and exports, by line."""
        line = lambda pos: self.text.count("\n", 0, pos) + 1
        out = []
        for d in self.declarations:
            names = [x for x in (d.default, f"* as {d.namespace}" if d.namespace else None) if x] + [n.local for n in d.names]
            shown = ", ".join(names[:3]) + (f", +{len(names) - 3} more" if len(names) > 3 else "")
            out.append((line(d.start), line(d.end), d.kind, d.spec or ", ".join(n.local for n in d.names), d.kind == "export", shown))
        out += [(d.line, d.end_line, d.kind, d.name, d.exported, d.signature) for d in self.definitions]
        return sorted(out, key=lambda r: r[:2])


def _signature(text: str, kind: str) -> str:
    """Head of a definition on one line, without its body."""
    head = text.split("{", 1)[0] if kind in ("function", "class", "interface", "enum", "namespace") else text.split("=", 1)[0]
    return re.sub(r"\s+", " ", head).strip().rstrip(";")


def leading_comments(module: Module, position: int) -> list[Comment]:
    """Comments directly before a position, with nothing but white space between."""
    out: list[Comment] = []
    for c in reversed([c for c in module.comments if c.end <= position]):
        if module.text[c.end : position].strip():
            break
        out.insert(0, c)
        position = c.start
    return out


def is_generated(module: Module) -> bool:
    return any("@generated" in c.text for c in module.comments)


def has_public_tag(module: Module, position: int) -> bool:
    return any("@public" in c.text for c in leading_comments(module, position))


def edit(text: str, edits: list[tuple[int, int, str]]) -> str:
    """Replace spans, last first; they must not overlap."""
    for start, end, new in sorted(edits, reverse=True):
        text = text[:start] + new + text[end:]
    return text


Tokens = list[Token]
