"""Tokens of TypeScript text, and the role that each name plays.

A pass over the tokens tells values, types, bound names, property names and keys apart. It knows
declarations, parameters, annotations, classes and object literals; it builds no tree.
"""

from __future__ import annotations

from dataclasses import dataclass

import regex

_NEXT = regex.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<id>[\p{L}_$\#][\p{L}\p{N}_$]*)|(?P<num>\d[\w.]*)
    |(?P<str>'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*")|(?P<tick>`)|(?P<p>=>|\.\.\.|\?\.(?!\d)|\?\?=?|\*\*=?|[=!]==?|&&=?|\|\|=?|[-+*/%&|^]=|\+\+|--|<=|.)""",
    regex.S | regex.X,
)
_REGEX = regex.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
_TEXT = regex.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*(?:`|\$\{)", regex.S)

# Words of the language.
STATEMENTS = {"import", "export", "const", "let", "var", "function", "class", "interface", "type", "enum", "declare", "abstract", "async", "namespace", "module", "if", "for", "while", "do", "return", "throw", "switch", "try", "break", "continue"}
RESERVED = STATEMENTS - {"type", "module", "namespace", "declare", "abstract", "async"} | {"new", "typeof", "instanceof", "in", "of", "as", "satisfies", "void", "delete", "await", "yield", "else", "case", "default", "catch", "finally", "extends", "implements", "this", "super", "null", "true", "false", "undefined", "static", "public", "private", "protected", "readonly", "override", "is", "keyof", "infer", "from", "get", "set", "with", "debugger"}
PLAIN_TYPES = {"string", "number", "boolean", "any", "unknown", "never", "void", "object", "symbol", "bigint", "null", "undefined", "true", "false", "this", "const"}
MODIFIERS = {"public", "private", "protected", "readonly", "static", "abstract", "override", "declare", "async", "accessor"}
_OPEN, _CLOSE = {"(", "[", "{", "${"}, {")", "]", "}"}


@dataclass(slots=True)
class Token:
    kind: str  # id, num, str, template, regex, p
    text: str
    start: int
    end: int
    line: int
    column: int
    fresh: bool  # first of its line
    role: str = ""  # value, type, query (after typeof), bind, prop, key
    match: int = -1  # index of the other bracket
    depth: int = 0


@dataclass(slots=True)
class Comment:
    text: str
    start: int
    end: int


def tokenize(text: str) -> tuple[list[Token], list[Comment]]:
    """Tokens without white space, with brackets matched, and the comments."""
    out: list[Token] = []
    comments: list[Comment] = []
    opened: list[int] = []
    at, line, begin, fresh = 0, 1, 0, True

    def add(kind: str, end: int) -> None:
        nonlocal fresh
        out.append(Token(kind, text[at:end], at, end, line, at - begin + 1, fresh, depth=len(opened)))
        fresh = False

    while at < len(text):
        m = _NEXT.match(text, at)
        kind, end = m.lastgroup, m.end()
        if kind == "p" and m[0] == "/" and (not out or out[-1].kind == "p" and out[-1].text not in (")", "]", "}") or out[-1].text in ("return", "typeof", "case", "in", "of")):
            if r := _REGEX.match(text, at):
                kind, end = "regex", r.end()
        closing = kind == "p" and m[0] == "}" and opened and out[opened[-1]].text == "${"
        if kind == "tick" or closing:
            if closing:
                add("p", end)
                out[-1].depth -= 1
                out[-1].match = opened.pop()
                out[out[-1].match].match = len(out) - 1
                line_at = at + 1
            else:
                line_at = at + 1
            t = _TEXT.match(text, line_at)
            stop = t.end() if t else len(text)
            more = bool(t) and text[stop - 2 : stop] == "${"
            lines = text.count("\n", at, stop)
            at_text = line_at if closing else at
            at = at_text
            add("template", stop - 2 if more else stop)
            if lines:
                line, begin = line + lines, text.rfind("\n", 0, stop) + 1
            at = stop
            if more:
                out.append(Token("p", "${", stop - 2, stop, line, stop - 1 - begin, False, depth=len(opened)))
                opened.append(len(out) - 1)
            continue
        if kind == "comment":
            comments.append(Comment(m[0], at, end))
        elif kind != "space":
            add(kind, end)
            if kind == "p" and m[0] in _OPEN:
                opened.append(len(out) - 1)
            elif kind == "p" and m[0] in _CLOSE and opened:
                out[-1].match = opened.pop()
                out[out[-1].match].match = len(out) - 1
                out[-1].depth = len(opened)
        if lines := text.count("\n", at, end):
            line, begin, fresh = line + lines, text.rfind("\n", at, end) + 1, True
        at = end
    return out, comments


class Roles:
    """Gives every identifier token its role."""

    def __init__(self, tokens: list[Token]):
        self.t = tokens
        self.scan(0, len(tokens), False)

    def text(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def is_id(self, i: int) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind == "id"

    def close(self, i: int) -> int:
        """Index after the bracket that closes the one at i."""
        return self.t[i].match + 1 if self.t[i].match > i else len(self.t)

    # Types

    def type_args(self, i: int) -> int:
        """After the ``<...>`` at i, or -1 if it is none."""
        at = i + 1
        while at < len(self.t):
            if self.text(at) == ">":
                return at + 1
            if self.is_id(at) and self.text(at + 1) in ("extends", "=") and self.text(at) != "typeof":
                self.t[at].role = "bind"
                at += 1
            after = self.type(at + 1 if self.text(at) in ("extends", "=", ",", "const") else at)
            if after <= at:
                return -1
            at = after
            if self.text(at) not in (",", ">", "=", "extends"):
                return -1
        return -1

    def type(self, i: int) -> int:
        """After the type at i; names in it get roles. Returns i if there is none."""
        at = i
        while True:
            while self.text(at) in ("|", "&", "keyof", "readonly", "unique", "infer", "asserts", "abstract", "new") and at + 1 < len(self.t):
                at += 1
            start, x = at, self.text(at)
            if x == "typeof" and self.is_id(at + 1):
                self.t[at + 1].role = "query"
                at = self.qualified(at + 1)
            elif x == "import" and self.text(at + 1) == "(":
                at = self.close(at + 1)
                while self.text(at) == "." and self.is_id(at + 1):
                    at += 2
            elif x in ("(", "<"):
                if x == "<":
                    at = max(self.type_args(at), at + 1)
                if self.text(at) == "(":
                    end = self.close(at)
                    if self.text(end) == "=>":
                        self.params(at + 1, end - 1)
                        at = self.type(end + 1)
                    else:
                        self.type(at + 1)
                        at = end
            elif x == "{":
                self.members(at + 1, self.close(at) - 1)
                at = self.close(at)
            elif x == "[":
                self.list_of_types(at + 1, self.close(at) - 1)
                at = self.close(at)
            elif x == "-" or start < len(self.t) and self.t[at].kind in ("num", "str"):
                at += 2 if x == "-" else 1
            elif start < len(self.t) and self.t[at].kind == "template":
                at += 1
                while self.text(at) == "${":
                    self.type(at + 1)
                    at = self.close(at) + 1
            elif self.is_id(at):
                if x not in PLAIN_TYPES:
                    self.t[at].role = "type"
                at = self.qualified(at)
            if at == start:
                return i if start == i else start
            while True:
                if self.text(at) == "[" and not self.t[at].fresh:
                    self.list_of_types(at + 1, self.close(at) - 1)
                    at = self.close(at)
                elif self.text(at) == "is" and self.is_id(at):
                    self.t[start].role = "prop"
                    at = self.type(at + 1)
                else:
                    break
            if self.text(at) == "extends":
                middle = self.type(at + 1)
                if self.text(middle) == "?":
                    yes = self.type(middle + 1)
                    at = self.type(yes + 1) if self.text(yes) == ":" else yes
            if self.text(at) not in ("|", "&"):
                return at

    def qualified(self, at: int) -> int:
        at += 1
        while self.text(at) == "." and self.is_id(at + 1):
            self.t[at + 1].role = "prop"
            at += 2
        if self.text(at) == "<":
            at = max(at, self.type_args(at))
        return at

    def list_of_types(self, at: int, end: int) -> None:
        while at < end:
            if self.is_id(at) and self.text(at + 1) in (":", "?") and self.text(at + 1 + (self.text(at + 1) == "?")) == ":":
                self.t[at].role = "key"
                at += 2 + (self.text(at + 1) == "?")
            after = self.type(at + 1 if self.text(at) in ("...", ",") else at)
            at = max(after, at + 1)

    def members(self, at: int, end: int) -> None:
        """Members of an interface or object type."""
        while at < end:
            x = self.text(at)
            if x in (";", ","):
                at += 1
            elif x == "[":
                stop = self.close(at) - 1
                if self.text(at + 2) == ":":
                    self.t[at + 1].role = "bind"
                    self.type(at + 3)
                elif self.text(at + 2) == "in":
                    self.t[at + 1].role = "bind"
                    self.type(at + 3)
                else:
                    self.scan(at + 1, stop, False)
                at = stop + 1
            elif x == "(":
                self.params(at + 1, self.close(at) - 1)
                at = self.close(at)
            elif x == "<":
                at = max(self.type_args(at), at + 1)
            elif x == ":":
                at = max(self.type(at + 1), at + 1)
            else:
                if self.is_id(at):
                    self.t[at].role = "key"
                at += 1

    def params(self, at: int, end: int) -> None:
        """Parameters: bound names, annotations, defaults."""
        while at < end:
            x = self.text(at)
            if x == ":":
                at = max(self.type(at + 1), at + 1)
            elif x == "=":
                at = self.scan(at + 1, end, True)
            elif x in ("{", "["):
                self.pattern(at + 1, self.close(at) - 1)
                at = self.close(at)
            elif x == "@":
                if self.is_id(at + 1):
                    self.t[at + 1].role = "value"
                at += 2
                if self.text(at) == "(":
                    self.scan(at + 1, self.close(at) - 1, False)
                    at = self.close(at)
            else:
                if self.is_id(at) and not (x in MODIFIERS and self.is_id(at + 1)):
                    self.t[at].role = "bind"
                at += 1

    def pattern(self, at: int, end: int) -> None:
        """Inside of a destructuring pattern."""
        while at < end:
            x = self.text(at)
            if x in ("{", "["):
                if x == "[" and self.text(self.close(at)) == ":":
                    self.scan(at + 1, self.close(at) - 1, False)
                else:
                    self.pattern(at + 1, self.close(at) - 1)
                at = self.close(at)
            elif x == "=":
                at = self.scan(at + 1, end, True)
            else:
                if self.is_id(at):
                    self.t[at].role = "key" if self.text(at + 1) == ":" else "bind"
                at += 1

    # Statements and expressions

    def variables(self, at: int, end: int) -> int:
        """Declarators after const, let or var."""
        while at < end:
            x = self.text(at)
            if x in ("{", "["):
                self.pattern(at + 1, self.close(at) - 1)
                at = self.close(at)
            elif self.is_id(at):
                self.t[at].role = "bind"
                at += 1
            if self.text(at) == "!":
                at += 1
            if self.text(at) == ":":
                at = self.type(at + 1)
            if self.text(at) == "=":
                at = self.scan(at + 1, end, True)
            if self.text(at) != ",":
                return at
            at += 1
        return at

    def function(self, at: int, end: int) -> int:
        """After ``function``: name, parameters, result, body."""
        if self.text(at) == "*":
            at += 1
        if self.is_id(at):
            self.t[at].role = "bind"
            at += 1
        return self.signature(at, end)

    def signature(self, at: int, end: int) -> int:
        if self.text(at) == "<":
            at = max(self.type_args(at), at + 1)
        if self.text(at) == "(":
            self.params(at + 1, self.close(at) - 1)
            at = self.close(at)
        if self.text(at) == ":":
            at = self.type(at + 1)
        if self.text(at) == "{":
            self.scan(at + 1, self.close(at) - 1, False)
            at = self.close(at)
        return at

    def klass(self, at: int, end: int) -> int:
        """After ``class``."""
        if self.is_id(at) and self.text(at) not in ("extends", "implements"):
            self.t[at].role = "bind"
            at += 1
        if self.text(at) == "<":
            at = max(self.type_args(at), at + 1)
        while at < end and self.text(at) != "{":
            x = self.text(at)
            if x == "implements":
                at = self.type(at + 1)
                while self.text(at) == ",":
                    at = self.type(at + 1)
            elif x == "extends":
                if self.is_id(at + 1):
                    self.t[at + 1].role = "value"
                at = self.qualified(at + 1) if self.is_id(at + 1) else at + 1
                if self.text(at) == "(":
                    self.scan(at + 1, self.close(at) - 1, False)
                    at = self.close(at)
            else:
                at += 1
        if at >= end:
            return end
        stop, at = self.close(at) - 1, at + 1
        while at < stop:
            at = self.member(at, stop)
        return stop + 1

    def member(self, at: int, stop: int) -> int:
        """One member of a class body."""
        x = self.text(at)
        if x in (";", ","):
            return at + 1
        if x == "@":
            if self.is_id(at + 1):
                self.t[at + 1].role = "value"
            at += 2
            return self.scan_group(at) if self.text(at) == "(" else at
        if x == "static" and self.text(at + 1) == "{":
            self.scan(at + 2, self.close(at + 1) - 1, False)
            return self.close(at + 1)
        if (x in MODIFIERS or x in ("get", "set")) and self.text(at + 1) not in ("(", "=", ":", ";", "?", "!", "<", "}"):
            return at + 1
        if x == "*":
            return at + 1
        if x == "[":
            self.scan(at + 1, self.close(at) - 1, False)
            at = self.close(at)
        else:
            if self.is_id(at):
                self.t[at].role = "key"
            at += 1
        while self.text(at) in ("?", "!"):
            at += 1
        if self.text(at) in ("(", "<"):
            return self.signature(at, stop)
        if self.text(at) == ":":
            at = self.type(at + 1)
        if self.text(at) == "=":
            at = self.scan(at + 1, stop, True)
        return at if at < stop and self.text(at) in (";",) or at >= stop else at

    def scan_group(self, at: int) -> int:
        self.scan(at + 1, self.close(at) - 1, False)
        return self.close(at)

    def is_block(self, at: int) -> bool:
        before = self.text(at - 1)
        return at == 0 or before in (")", "=>", ";", "{", "}", "else", "do", "try", "finally") or self.t[at].fresh and self.t[at - 1].kind != "p"

    def arrow(self, at: int) -> int:
        """If parameters in brackets begin at ``at``: after the arrow's ``=>``; else -1."""
        end = self.close(at)
        if self.text(end) == "=>":
            self.params(at + 1, end - 1)
            return end + 1
        if self.text(end) == ":" and self.text(at - 1) not in ("?",):
            saved = [(t, t.role) for t in self.t[end : end + 200]]
            after = self.type(end + 1)
            if self.text(after) == "=>" and after > end + 1:
                self.params(at + 1, end - 1)
                return after + 1
            for t, role in saved:
                t.role = role
        return -1

    def literal(self, at: int, end: int) -> None:
        """Inside of an object literal."""
        while at < end:
            x = self.text(at)
            if x in (",", "*") or x in ("async", "get", "set") and self.text(at + 1) not in (":", ",", "(", "}"):
                at += 1
            elif x == "...":
                at = self.scan(at + 1, end, True)
            elif x == "[":
                at = self.scan_group(at)
            elif x in ("(", "<"):
                at = self.signature(at, end)
            elif x == ":":
                at = self.scan(at + 1, end, True)
            else:
                if self.is_id(at):
                    self.t[at].role = "key" if self.text(at + 1) in (":", "(", "<") else "value"
                at = self.scan(at + 2, end, True) if self.text(at + 1) == "=" else at + 1

    def scan(self, at: int, end: int, one: bool) -> int:
        """Statements from at to end, or ``one`` expression: up to a comma or the end of the statement."""
        begin = at
        while at < end:
            t, x = self.t[at], self.text(at)
            if one and (x in (",", ";", ")", "]", "}") or at > begin and t.fresh and (x in STATEMENTS or x in MODIFIERS or x in ("get", "set", "@", "[") or t.kind == "id" and not self.continues(at - 1)) and not self.continues(at - 1)):
                return at
            if t.kind != "id":
                if x == "(":
                    after = self.arrow(at)
                    at = after if after > 0 else self.scan_group(at)
                elif x == "{":
                    if self.is_block(at):
                        self.scan(at + 1, self.close(at) - 1, False)
                    else:
                        self.literal(at + 1, self.close(at) - 1)
                    at = self.close(at)
                elif x in ("[", "${"):
                    at = self.scan_group(at)
                elif x == "<" and self.text(at - 1) in ("=", "(", ",", "=>", "return") and (after := self.type_args(at)) > 0 and self.text(after) == "(":
                    at = after
                else:
                    at += 1
                continue
            if self.text(at - 1) in (".", "?."):
                t.role = "prop"
                at += 1
            elif x in ("const", "let", "var") and not (x == "const" and self.text(at + 1) == "enum"):
                at = self.variables(at + 1, end)
            elif x == "function":
                at = self.function(at + 1, end)
            elif x == "class":
                at = self.klass(at + 1, end)
            elif x == "interface" and self.is_id(at + 1):
                at = self.interface(at + 1, end)
            elif x == "type" and self.is_id(at + 1) and self.text(at + 2) in ("=", "<"):
                self.t[at + 1].role = "bind"
                at += 2
                if self.text(at) == "<":
                    at = max(self.type_args(at), at + 1)
                at = self.type(at + 1)
            elif x in ("namespace", "module") and at + 1 < end and self.t[at + 1].kind in ("id", "str") or x == "global" and self.text(at + 1) == "{":
                if self.is_id(at + 1):
                    self.t[at + 1].role = "bind"
                t.role = "prop"
                while at < end and self.text(at) != "{":
                    at += 1
                at = self.scan_group(at) if at < end else at
            elif x == "enum" and self.is_id(at + 1):
                self.t[at + 1].role = "bind"
                self.literal(at + 3, self.close(at + 2) - 1) if self.text(at + 2) == "{" else None
                at = self.close(at + 2) if self.text(at + 2) == "{" else at + 2
            elif x == "import" and self.text(at + 1) not in ("(", "."):
                at = self.clause(at + 1, end)
            elif x == "export" and (self.text(at + 1) in ("{", "*") or self.text(at + 1) == "type" and self.text(at + 2) in ("{", "*")):
                at = self.clause(at + 1, end)
            elif x in ("as", "satisfies") and at > begin and self.t[at - 1].kind != "p" or x in ("as", "satisfies") and self.text(at - 1) in (")", "]", "}"):
                at = max(self.type(at + 1), at + 1)
            elif x == "catch" and self.text(at + 1) == "(":
                self.params(at + 2, self.close(at + 1) - 1)
                at = self.close(at + 1)
            elif x in RESERVED or x == "declare" and self.is_id(at + 1) or x == "async" and (self.is_id(at + 1) or self.text(at + 1) == "(") and not self.t[at + 1].fresh or x == "abstract" and self.text(at + 1) == "class":
                at += 1
            elif self.text(at + 1) == "=>":
                t.role = "bind"
                at += 2
            elif self.text(at + 1) == ":" and not one and (at == begin or self.text(at - 1) in (";", "{", "}")):
                t.role = "key"  # a label
                at += 2
            else:
                t.role = "value"
                at += 1
                if self.text(at) == "<":
                    saved = [(k, k.role) for k in self.t[at : at + 200]]
                    after = self.type_args(at)
                    if after > 0 and self.text(after) in ("(",):
                        at = after
                    else:
                        for k, role in saved:
                            k.role = role
        return at

    def continues(self, at: int) -> bool:
        """Whether an expression goes on after the token at ``at``."""
        t = self.t[at]
        return t.kind == "p" and t.text not in (")", "]", "}", "++", "--", "!") or t.text in ("typeof", "new", "await", "void", "delete", "in", "of", "instanceof", "extends", "return", "as")

    def interface(self, at: int, end: int) -> int:
        self.t[at].role = "bind"
        at += 1
        if self.text(at) == "<":
            at = max(self.type_args(at), at + 1)
        while at < end and self.text(at) != "{":
            at = self.type(at + 1) if self.text(at) in ("extends", ",") else at + 1
        if at < end:
            self.members(at + 1, self.close(at) - 1)
            at = self.close(at)
        return at

    def clause(self, at: int, end: int) -> int:
        """Names of an import or export declaration, which are no uses; up to its end."""
        while at < end and self.t[at].kind != "str" and self.text(at) != ";":
            if self.is_id(at):
                self.t[at].role = "prop"
            if self.text(at) == "{":
                for k in range(at + 1, self.close(at) - 1):
                    self.t[k].role = "prop" if self.is_id(k) else ""
                at = self.close(at)
                if self.text(at) != "from":
                    return at
                continue
            at += 1
        return at + 1
