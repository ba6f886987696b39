"""Parsers of Go, JavaScript and TypeScript over a token stream: declarations with spans, what they contain,
imports with their bindings, and symbol uses (calls, heritage, embedding).

They read structure (brackets, declarations, statements), not types: enough to name what a file declares and
what it uses, and to fail on text whose strings or brackets do not close.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class ParseError(ValueError):
    """A string, comment or bracket that does not close."""


@dataclass
class Token:
    kind: str  # id, str, num, op
    text: str
    line: int
    column: int
    comment: str = ""  # the comment lines right above


@dataclass
class Parsed:
    """Plain rows; the file itself is the first node.

    nodes: kind, label, qualified name within the file, token range; edges: (source, target, relation) by node
    id; references: specifier, kind, line, ambiguous, bindings [(imported, local)]; symbols: source id, target,
    receiver type, relation, line.
    """

    path: str
    language: str
    nodes: list[dict] = field(default_factory=list)
    edges: list[tuple[str, str, str]] = field(default_factory=list)
    references: list[tuple] = field(default_factory=list)
    symbols: list[tuple] = field(default_factory=list)
    exports: list[tuple[str, str]] = field(default_factory=list)


WORD = re.compile(r"[A-Za-z_$\u0080-￿][\w$]*")
NUMBER = re.compile(r"\d[\w.]*")
OPERATOR = re.compile(r"=>|\.\.\.|:=|&&|\|\||[^\s\w]")
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
CLOSES = {")": "(", "]": "[", "}": "{"}


def tokens(text: str, language: str) -> list[Token]:
    """Tokens without comments; a declaration's token keeps the comment above it."""
    out, at, line, start, comment, comment_line = [], 0, 1, 0, [], 0
    open_: list[Token] = []
    n = len(text)
    while at < n:
        c = text[at]
        if c == "\n":
            at, line, start = at + 1, line + 1, at + 1
            continue
        if c.isspace():
            at += 1
            continue
        if text.startswith("//", at) or text.startswith("/*", at):
            block = text[at + 1] == "*"
            end = text.find("*/" if block else "\n", at + 2)
            if end < 0:
                if block:
                    raise ParseError(f"line {line}: a comment does not close")
                end = n
            body = text[at:end]
            if comment_line < line - 1:
                comment = []
            comment += [x.strip(" \t*/") for x in body.split("\n")]
            end += 2 * block
            line += text.count("\n", at, end)
            start = text.rfind("\n", 0, end) + 1
            at, comment_line = end, line
            continue
        quote = c in "\"'`"
        previous = out[-1] if out else None
        value_before = previous is not None and (previous.kind in ("id", "num", "str") and previous.text not in ("return", "typeof", "case", "in", "of") or previous.text in ")]}")
        if quote:
            end = at + 1
            while end < n and text[end] != c:
                if text[end] == "\\" and not (language == "go" and c == "`"):
                    end += 1
                elif text[end] == "\n" and c != "`":
                    break
                end += 1
            if end >= n or text[end] != c:
                raise ParseError(f"line {line}: a string does not close")
            end += 1
            kind = "str"
        elif m := WORD.match(text, at):
            end, kind = m.end(), "id"
        elif c.isdigit():
            end, kind = NUMBER.match(text, at).end(), "num"
        elif c == "/" and language != "go" and not value_before and (m := REGEX.match(text, at)):
            end, kind = m.end(), "num"
        else:
            end, kind = OPERATOR.match(text, at).end(), "op"
        t = Token(kind, text[at:end], line, at - start + 1, " ".join(x for x in comment if x) if comment_line >= line - 1 else "")
        comment = []
        if kind == "op":
            if t.text in ("(", "[", "{"):
                open_.append(t)
            elif t.text in CLOSES:
                if not open_ or open_.pop().text != CLOSES[t.text]:
                    raise ParseError(f"line {line}: {t.text} closes nothing")
        out.append(t)
        line += text.count("\n", at, end)
        if "\n" in text[at:end]:
            start = text.rfind("\n", 0, end) + 1
        at = end
    if open_:
        raise ParseError(f"line {open_[-1].line}: {open_[-1].text} does not close")
    return out


class Reader:
    """What the parsers share: token access, bracket skipping, adding nodes."""

    def __init__(self, path: str, language: str, text: str):
        self.text, self.t = text, tokens(text, language)
        self.out = Parsed(path, language)
        lines = text.count("\n") + 1
        self.out.nodes.append({"node_id": f"file:{path}", "kind": "file", "label": path.rsplit("/", 1)[-1], "qualified_name": path, "line": 1, "start_column": 1, "end_line": lines, "end_column": len(text) - text.rfind("\n"), "exported": True, "owner": "", "signature": "", "comments": []})
        self.match = {}
        stack = []
        for i, t in enumerate(self.t):
            if t.kind == "op" and t.text in ("(", "[", "{"):
                stack.append(i)
            elif t.kind == "op" and t.text in CLOSES:
                self.match[stack.pop()] = i

    def is_(self, i: int, *texts: str) -> bool:
        return 0 <= i < len(self.t) and self.t[i].kind != "str" and self.t[i].text in texts

    def word(self, i: int) -> str | None:
        return self.t[i].text if 0 <= i < len(self.t) and self.t[i].kind == "id" else None

    def string(self, i: int) -> str | None:
        return self.t[i].text[1:-1] if 0 <= i < len(self.t) and self.t[i].kind == "str" else None

    def after(self, i: int) -> int:
        """The index behind a bracket's end, or behind a plain token."""
        return self.match.get(i, i) + 1

    def until(self, i: int, *texts: str) -> int:
        """The next index with one of the texts outside brackets, or the end."""
        while i < len(self.t) and not self.is_(i, *texts):
            i = self.after(i)
        return i

    def statement_end(self, i: int) -> int:
        """The end of a statement that begins at ``i``: a semicolon, or a line that the next one does not continue."""
        while i < len(self.t):
            j = self.after(i)
            if self.is_(j - 1, ";") or j >= len(self.t):
                return j
            last, following = self.t[j - 1], self.t[j]
            if following.line > last.line and not (last.kind == "op" and last.text not in (")", "]", "}", ">")) and not (following.kind == "op" and following.text in (".", ",", "?", ":", "=", "=>", "+", "|", "&", "&&", "||", "{")):
                return j
            i = j
        return len(self.t)

    def add(self, kind: str, name: str, first: int, last: int, exported: bool, owner: str = "", parent: str | None = None) -> str:
        o = self.out
        local = f"{owner}.{name}" if owner else name
        node = f"{o.language}:{kind}:{o.path}#{local}"
        a, b = self.t[first], self.t[min(last, len(self.t)) - 1]
        body = next((j for j in range(first, min(last, len(self.t))) if self.is_(j, "{")), last)
        words = " ".join(x.text for x in self.t[first:body])
        end_line = b.line + b.text.count("\n")
        end_column = b.column + len(b.text) if end_line == b.line else len(b.text) - b.text.rfind("\n")
        o.nodes.append({"node_id": node, "kind": f"{o.language}:{kind}", "label": name, "qualified_name": f"{o.path}::{local}", "line": a.line, "start_column": a.column, "end_line": end_line, "end_column": end_column, "exported": exported, "owner": owner, "signature": words, "comments": [a.comment] if a.comment else []})
        if parent is None:
            o.edges.append((f"file:{o.path}", node, "defines"))
        else:
            o.edges.append((parent, node, "contains"))
        return node

    def refer(self, specifier: str, kind: str, line: int, bindings: list[tuple[str, str]] = (), ambiguous: bool = False) -> None:
        self.out.references.append((specifier, kind, line, ambiguous, list(bindings)))

    def use(self, source: str, target: str, relation: str, line: int, receiver: str = "") -> None:
        self.out.symbols.append((source, target, receiver, f"{self.out.language}:{relation}", line))


class Go(Reader):
    """Packages, types, functions, methods, constants, variables; imports; calls with receiver types."""

    KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var make new len cap append panic recover copy delete print println close min max clear".split())

    def parse(self) -> Parsed:
        i = 0
        while i < len(self.t):
            w = self.word(i)
            if w == "package" and self.word(i + 1):
                self.out.nodes.append(self.out.nodes[0] | {"node_id": f"go:package:{self.out.path}#{self.word(i + 1)}", "kind": "go:package", "label": self.word(i + 1), "qualified_name": f"{self.out.path}::{self.word(i + 1)}", "line": self.t[i].line})
                self.out.edges.append((f"file:{self.out.path}", f"go:package:{self.out.path}#{self.word(i + 1)}", "defines"))
                i += 2
            elif w in ("import", "type", "const", "var"):
                one = getattr(self, f"one_{w}")
                if self.is_(i + 1, "("):
                    j, end = i + 2, self.match[i + 1]
                    while j < end:
                        j = min(end, max(j + 1, one(j)))
                    i = end + 1
                else:
                    i = max(i + 2, one(i + 1))
            elif w == "func":
                i = self.function(i)
            else:
                i = self.after(i)
        return self.out

    @staticmethod
    def public(name: str) -> bool:
        return "A" <= name[:1] <= "Z"

    def one_import(self, i: int) -> int:
        alias = ""
        if self.word(i) or self.is_(i, "."):
            alias, i = self.t[i].text, i + 1
        if (s := self.string(i)) is not None:
            self.refer(s, "import", self.t[i].line, [("*", alias)] if alias not in ("", "_") else [])
        return i + 1

    def names(self, i: int) -> list[int]:
        found = []
        while self.word(i):
            found.append(i)
            if not self.is_(i + 1, ","):
                break
            i += 2
        return found

    def one_const(self, i: int, kind: str = "constant") -> int:
        end = self.statement_end(i)
        for k in self.names(i):
            name = self.word(k)
            if name != "_":
                self.add(kind, name, k - (k == i and self.word(k - 1) in ("const", "var")), end, self.public(name))
        return end

    def one_var(self, i: int) -> int:
        return self.one_const(i, "variable")

    def one_type(self, i: int) -> int:
        name = self.word(i)
        if not name:
            return i + 1
        j = i + 1
        if self.is_(j, "[") and self.word(j + 1) and not self.is_(j + 2, "]"):
            j = self.after(j)
        alias = self.is_(j, "=")
        what = self.word(j + alias)
        end = self.after(j + 1) if what in ("struct", "interface") and not alias and self.is_(j + 1, "{") else self.statement_end(i)
        kind = "type_alias" if alias else what if what in ("struct", "interface") else "type"
        node = self.add(kind, name, i - (self.word(i - 1) == "type"), end, self.public(name))
        if kind in ("struct", "interface"):
            self.members(node, name, kind, j + 1)
        return end

    def members(self, node: str, name: str, kind: str, at: int) -> None:
        """Embedded types of a struct or interface, and the methods that an interface requires."""
        k, end = at + 1, self.match[at]
        while k < end:
            line, first = self.t[k].line, k
            while k < end and self.t[k].line == line and not self.is_(k, ";"):
                k = self.after(k)
            k += self.is_(k, ";")
            row = self.t[first:k]
            texts = [t.text for t in row if not (t.kind == "str")]
            texts = texts[:-1] if texts[-1:] == [";"] else texts
            field_ = any(self.word(a) and self.word(a + 1) and self.t[a].line == self.t[a + 1].line for a in range(first, k - 1))
            if kind == "interface" and self.word(first) and self.is_(first + 1, "("):
                self.use(node, self.word(first), "requires", line)
            elif texts and not field_ and (body := "".join(texts).lstrip("*")) and re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?(\[.*\])?", body) and len(texts) <= 4:
                self.use(node, body.split("[")[0], "embeds", line)
            k = max(k, first + 1)

    def parameters(self, at: int) -> dict[str, str]:
        """Names to plain type names of a parameter list."""
        found, pending, k, end = {}, [], at + 1, self.match[at]
        while k < end:
            if self.word(k):
                pending.append(self.word(k))
                j = k + 1
                while self.is_(j, "*", "...", "[", "]"):
                    j = self.after(j) if self.is_(j, "[") else j + 1
                if self.word(j) and not self.is_(k + 1, ","):
                    kind = self.word(j)
                    j += 1
                    if self.is_(j, ".") and self.word(j + 1):
                        kind, j = f"{kind}.{self.word(j + 1)}", j + 2
                    found |= {p: kind for p in pending}
                    pending, k = [], j
                    continue
            k = self.after(k)
        return found

    def function(self, i: int) -> int:
        j, owner, types = i + 1, "", {}
        if self.is_(j, "("):
            types = self.parameters(j)
            owner = next(iter(types.values()), "") or next((t.text for t in self.t[j + 1 : self.match[j]] if t.kind == "id"), "")
            j = self.match[j] + 1
        name = self.word(j)
        if not name:
            return self.after(i)
        k = j + 1
        if self.is_(k, "["):
            k = self.after(k)
        if not self.is_(k, "("):
            return k
        types |= self.parameters(k)
        body = self.match[k] + 1
        while body < len(self.t) and not self.is_(body, "{") and (self.t[body].line == self.t[self.match[k]].line or self.t[body].line == self.t[body - 1].line):
            body = body + 2 if self.is_(body, "interface", "struct") and self.is_(body + 1, "{") and self.match[body + 1] == body + 2 else self.after(body)
        end = self.after(body) if self.is_(body, "{") else body
        node = self.add("method" if owner else "function", name, i, end, self.public(name), owner)
        if self.is_(body, "{"):
            self.calls(node, body, types)
        return end

    def calls(self, node: str, body: int, types: dict[str, str]) -> None:
        types = dict(types)
        for k in range(body + 1, self.match[body]):
            w = self.word(k)
            if not w:
                continue
            if self.is_(k + 1, ":=") or w == "var" and self.word(k + 1):
                name, j = (w, k + 2) if w != "var" else (self.word(k + 1), k + 2)
                j += self.is_(j, "&", "*")
                if self.word(j) and (w == "var" or self.is_(j + 1, "{") or self.is_(j + 1, ".") and self.is_(j + 3, "{")):
                    types[name] = f"{self.word(j)}.{self.word(j + 2)}" if self.is_(j + 1, ".") and self.word(j + 2) else self.word(j)
            if not self.is_(k + 1, "(") or w in self.KEYWORDS or self.is_(k - 1, "func"):
                continue
            line = self.t[k].line
            if self.is_(k - 1, "."):
                before = self.word(k - 2)
                if before and not self.is_(k - 3, "."):
                    if before in types:
                        self.use(node, w, "calls", line, types[before])
                    else:
                        self.use(node, f"{before}.{w}", "calls", line)
            else:
                self.use(node, w, "calls", line)


class Script(Reader):
    """JavaScript and TypeScript: classes, functions, interfaces, aliases, variables; imports and exports;
    heritage and calls."""

    KEYWORDS = frozenset("if for while switch catch function return typeof new await async import require super constructor of in delete void throw else do try yield case instanceof".split())

    def parse(self) -> Parsed:
        self.types = self.out.language == "typescript"
        self.named: dict[str, str] = {}
        i = 0
        while i < len(self.t):
            i = max(i + 1, self.statement(i))
        self.dynamic()
        names = {n["label"]: n for n in self.out.nodes[1:] if not n["owner"]}
        for local, exported in self.out.exports:
            if local in names:
                names[local]["exported"] = True
                self.named[exported] = names[local]["node_id"]
        return self.out

    def statement(self, i: int) -> int:
        exported, first = False, i
        if self.word(i) == "export":
            exported, i = True, i + 1
            if self.is_(i, "*") or self.is_(i, "{"):
                return self.export_list(i)
            if self.word(i) == "type" and self.is_(i + 1, "{"):
                return self.export_list(i + 1)
            if self.word(i) == "default":
                i += 1
                if self.word(i) and self.word(i) not in ("class", "function", "async", "abstract"):
                    self.out.exports.append((self.word(i), "default"))
        while self.word(i) in ("declare", "abstract") or self.word(i) == "async" and self.word(i + 1) == "function":
            i += 1
        w = self.word(i)
        if w == "import" and not self.is_(i + 1, "("):
            return self.import_(i)
        if w == "class":
            return self.class_(first, i, exported)
        if w == "function":
            return self.function(first, i, exported)
        if self.types and w == "interface" and self.word(i + 1):
            return self.interface(first, i, exported)
        if self.types and w == "type" and self.word(i + 1):
            end = self.statement_end(i)
            self.add("type_alias", self.word(i + 1), first, end, exported)
            return end
        if w in ("const", "let", "var"):
            return self.variables(first, i, exported)
        end = self.statement_end(i)
        self.calls(self.out.nodes[0]["node_id"], i, end, "")
        return end

    def braces(self, at: int) -> list[tuple[str, str]]:
        """(imported, local) of ``{a, b as c, type d}`` and ``{a, b: c}``."""
        found, k, end = [], at + 1, self.match[at]
        while k < end:
            if self.word(k) == "type" and self.word(k + 1) and not self.is_(k + 1, "as"):
                k += 1
            name = self.word(k) or self.string(k)
            if name:
                if self.word(k + 1) == "as":
                    found.append((name, self.word(k + 2) or self.string(k + 2) or name))
                    k += 2
                elif self.is_(k + 1, ":") and self.word(k + 2):
                    found.append((name, self.word(k + 2)))
                    k += 2
                else:
                    found.append((name, name))
            k += 1
        return found

    def import_(self, i: int) -> int:
        line, bindings, j = self.t[i].line, [], i + 1
        if self.word(j) == "type" and (self.is_(j + 1, "{", "*") or self.word(j + 1) and self.word(j + 1) != "from"):
            j += 1
        if self.word(j) and self.word(j) != "from":
            bindings.append(("default", self.word(j)))
            j += 1
            if self.is_(j, "=") and self.word(j + 1) == "require":  # import x = require("y")
                return self.statement_end(i)
        j += self.is_(j, ",")
        if self.is_(j, "*") and self.word(j + 1) == "as":
            bindings.append(("*", self.word(j + 2) or ""))
            j += 3
        elif self.is_(j, "{"):
            bindings += self.braces(j)
            j = self.after(j)
        j += self.word(j) == "from"
        if (s := self.string(j)) is not None:
            self.refer(s, "import", line, bindings)
            return j + 1
        return j

    def export_list(self, i: int) -> int:
        line = self.t[i].line
        if self.is_(i, "*"):
            j, bindings = i + 1, [("*", "*")]
            if self.word(j) == "as":
                bindings, j = [("*", self.word(j + 1) or "")], j + 2
        else:
            bindings, j = self.braces(i), self.after(i)
        if self.word(j) == "from" and (s := self.string(j + 1)) is not None:
            self.refer(s, "re_export", line, bindings)
            return j + 2
        self.out.exports += bindings
        return j

    def heritage(self, node: str, i: int, end: int) -> None:
        relation = ""
        while i < end:
            if self.word(i) in ("extends", "implements"):
                relation = self.word(i)
            elif self.word(i) and relation:
                name, j = self.word(i), i + 1
                while self.is_(j, ".") and self.word(j + 1):
                    name, j = f"{name}.{self.word(j + 1)}", j + 2
                self.use(node, name, relation, self.t[i].line)
                i = j
                if self.is_(i, "<"):
                    depth = 0
                    while i < end:
                        depth += self.is_(i, "<") - self.is_(i, ">")
                        i += 1
                        if not depth:
                            break
                continue
            i += 1

    def class_(self, first: int, i: int, exported: bool) -> int:
        name = self.word(i + 1) if self.word(i + 1) not in (None, "extends", "implements") else "default"
        body = self.until(i + 1, "{")
        if body >= len(self.t):
            return body
        end = self.after(body)
        node = self.add("class", name, first, end, exported)
        if self.word(first + 1) == "default":
            self.out.exports.append((name, "default"))
        self.heritage(node, i + 1, body)
        k = body + 1
        while k < self.match[body]:
            start = k
            while self.word(k) in ("public", "private", "protected", "static", "async", "readonly", "override", "get", "set", "abstract", "declare") and not self.is_(k + 1, "(", "=", ";", ":"):
                k += 1
            k += self.is_(k, "*", "#")
            if self.is_(k, "@"):
                k = self.after(k + 2) if self.is_(k + 2, "(") else k + 2
                continue
            if self.word(k):
                at = k + 1
                if self.is_(at, "<"):
                    at = self.until(at, "(")
                if self.is_(at, "("):
                    inner = self.match[at] + 1
                    if self.is_(inner, ":"):
                        inner = self.until(inner, "{", ";")
                    stop = self.after(inner) if self.is_(inner, "{") else inner
                    method = self.add("method", self.word(k), start, stop, False, name, node)
                    if self.is_(inner, "{"):
                        self.calls(method, inner, stop, name)
                    k = stop
                else:
                    stop = min(self.statement_end(k), self.match[body])
                    self.calls(node, k, stop, name)
                    k = stop
            else:
                k = self.after(k)
            k = max(k, start + 1)
        return end

    def function(self, first: int, i: int, exported: bool) -> int:
        j = i + 1 + self.is_(i + 1, "*")
        name = self.word(j) or "default"
        body = self.until(self.after(self.until(j, "(")), "{", ";")
        end = self.after(body)
        node = self.add("function", name, first, end, exported)
        if self.word(first + 1) == "default":
            self.out.exports.append((name, "default"))
        if self.is_(body, "{"):
            self.calls(node, body, end, "")
        return end

    def interface(self, first: int, i: int, exported: bool) -> int:
        body = self.until(i + 1, "{")
        end = self.after(body)
        self.heritage(self.add("interface", self.word(i + 1), first, end, exported), i + 1, body)
        return end

    def variables(self, first: int, i: int, exported: bool) -> int:
        end, j = self.statement_end(i), i + 1
        nodes = []
        while j < end:
            if self.is_(j, "{"):
                names = [local for _, local in self.braces(j)]
            else:
                names = [self.word(j)] if self.word(j) else []
            nodes = [self.add("variable", n, first, end, exported) for n in names] or nodes
            stop = self.until(j, ",", ";")
            if nodes:
                self.calls(nodes[0], j, min(stop, end), "")
            j = min(stop, end) + 1
        return end

    def calls(self, node: str, start: int, end: int, owner: str) -> None:
        for k in range(start, min(end, len(self.t))):
            w = self.word(k)
            if not w or not self.is_(k + 1, "(") or w in self.KEYWORDS or self.word(k - 1) == "function":
                continue
            line = self.t[k].line
            if self.is_(k - 1, "."):
                before = self.word(k - 2)
                if before == "this" and owner:
                    self.use(node, w, "calls", line, owner)
                elif before and not self.is_(k - 3, "."):
                    self.use(node, f"{before}.{w}", "calls", line)
            elif not (self.is_(self.match[k + 1] + 1, "{") and owner and self.is_(k - 1, "{", "}", ";")):
                self.use(node, w, "calls", line)

    def dynamic(self) -> None:
        """``require(...)`` and ``import(...)`` of strings, joined strings, and both ends of a choice."""
        for k in range(len(self.t)):
            if self.word(k) not in ("require", "import") or not self.is_(k + 1, "(") or self.is_(k - 1, "."):
                continue
            kind, line = ("require" if self.word(k) == "require" else "import"), self.t[k].line
            first, end = k + 2, self.match[k + 1]
            ask = self.until(first, "?")
            if ask < end:
                colon = self.until(ask + 1, ":")
                options = [self.joined(ask + 1, colon), self.joined(colon + 1, end)]
            else:
                options = [self.joined(first, end)]
            bindings = []
            if kind == "require" and self.is_(k - 1, "="):
                if self.is_(k - 2, "}"):
                    at = next(a for a, b in self.match.items() if b == k - 2)
                    pairs = self.braces(at)
                    bindings = pairs
                elif self.word(k - 2):
                    bindings = [("*", self.word(k - 2))]
            for s in options:
                if s is not None:
                    self.refer(s, kind, line, bindings, len(options) > 1)

    def joined(self, i: int, end: int) -> str | None:
        parts = []
        while i < end:
            s = self.string(i)
            if s is None or "${" in s and self.t[i].text[0] == "`":
                return None
            parts.append(s)
            if i + 1 < end and not self.is_(i + 1, "+"):
                return None
            i += 2
        return "".join(parts) if parts else None


PARSERS = {"go": Go, "javascript": Script, "typescript": Script}


def parse(path: str, language: str, text: str) -> Parsed:
    """One file's rows; text whose strings or brackets do not close is an error."""
    return PARSERS[language](path, language, text).parse()
