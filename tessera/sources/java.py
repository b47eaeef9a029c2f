"""Symbols and references of Java, JavaScript and TypeScript files, by a tolerant tokenizer.

Files are independent, so extraction is one pass of a Python function over their
rows (Spark has no parser); what it finds is resolved by joins. A file that can't be
read through gives the symbols found so far and a note in errors.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.lineage import cut

_TOKEN = re.compile(r'//[^\n]*|/\*.*?\*/|"""(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|[A-Za-z_$][\w$]*|\d[\w.]*|->|::|[{}()\[\];,.@<>=]|\S', re.S)
_MODIFIERS = {"public", "private", "protected", "static", "abstract", "final", "synchronized", "native", "default", "transient", "volatile", "strictfp", "sealed"}
_TYPES = {"class": "class", "interface": "interface", "enum": "enum", "record": "class"}
_NO_CALLS = {"if", "for", "while", "switch", "catch", "return", "new", "synchronized", "try", "throw", "super", "this", "assert", "else", "do", "case"}


class Token(NamedTuple):
    text: str
    line: int
    column: int


class Node(NamedTuple):
    id: str
    kind: str
    name: str
    qualified_name: str
    file_path: str
    language: str
    start_line: int
    end_line: int
    docstring: str | None
    signature: str | None
    visibility: str
    is_exported: bool
    is_static: bool
    is_abstract: bool
    decorators: list[str]
    return_type: str | None


class Ref(NamedTuple):
    from_node_id: str
    reference_name: str
    reference_kind: str
    receiver: str | None
    line: int
    file_path: str


def node_id(path: str, kind: str, name: str, line: int) -> str:
    digest = hashlib.sha256(f"{path}:{kind.upper()}:{name}:{line}".encode()).hexdigest()[:32]
    return f"{kind.upper()}:{digest}" if kind != "file" else f"file:{digest}"


def tokens(text: str) -> list[Token]:
    starts = [0]
    for m in re.finditer("\n", text):
        starts.append(m.end())
    out, line = [], 0
    for m in _TOKEN.finditer(text):
        while line + 1 < len(starts) and starts[line + 1] <= m.start():
            line += 1
        out.append(Token(m[0], line + 1, m.start() - starts[line]))
    return out


def clean_comment(raw: str) -> str:
    body = re.sub(r"^/\*+|\*+/$", "", raw)
    return "\n".join(x for x in (re.sub(r"^\s*(\*+|//+)?\s?", "", line).rstrip() for line in body.split("\n")) if x)


class _Reader:
    """Walks the tokens of one Java file."""

    def __init__(self, path: str, text: str) -> None:
        self.path, self.every = path, tokens(text)
        self.toks = [t for t in self.every if not t.text.startswith(("//", "/*"))]
        self.comments = {}
        last = None
        for t in self.every:
            if t.text.startswith(("//", "/*")):
                last = f"{last}\n{t.text}" if last else t.text
            else:
                if last:
                    self.comments[(t.line, t.column)] = last
                last = None
        self.nodes: list[Node] = []
        self.edges: list[tuple[str, str, str, int]] = []
        self.refs: list[Ref] = []
        self.errors: str | None = None
        self.package = ""
        lines = text.count("\n") + 1
        self.file = self._add("file", path.rsplit("/", 1)[-1], path, 1, lines, None)

    def _add(self, kind, name, qualified, line, end, owner, doc=None, signature=None, modifiers=(), decorators=(), returns=None) -> Node:
        visibility = next((m.upper() for m in ("public", "private", "protected") if m in modifiers), "INTERNAL")
        exported = visibility in ("PUBLIC", "PROTECTED") or kind in ("class", "interface", "enum")
        n = Node(node_id(self.path, kind, name, line), kind, name, qualified, self.path, "java", line, end, doc, signature, visibility, exported, "static" in modifiers, "abstract" in modifiers, list(decorators), returns)
        self.nodes.append(n)
        if owner is not None:
            self.edges.append((owner.id, n.id, "contains", line))
        return n

    def _match(self, i: int, open_: str, close: str) -> int:
        """The place of the token that closes the one at i, or the end."""
        depth = 0
        while i < len(self.toks):
            depth += (self.toks[i].text == open_) - (self.toks[i].text == close)
            if not depth:
                return i
            i += 1
        self.errors = f"no {close} for a {open_}"
        return len(self.toks) - 1

    def _dotted(self, i: int) -> tuple[str, int]:
        parts = []
        while i < len(self.toks) and self.toks[i].text != ";":
            parts.append(self.toks[i].text)
            i += 1
        return "".join(p for p in parts if p != "static"), i + 1

    def run(self) -> _Reader:
        i, module = 0, None
        while i < len(self.toks):
            t = self.toks[i]
            if t.text == "package":
                self.package, i = self._dotted(i + 1)
                module = self._add("module", self.package, self.package, t.line, t.line, self.file)
            elif t.text == "import":
                name, i = self._dotted(i + 1)
                n = self._add("import", name, name, t.line, t.line, module or self.file)
                if module:
                    self.edges.append((module.id, n.id, "imports", t.line))
            else:
                i = self._member(i, len(self.toks), self.file, self.package, None)
        return self

    def _member(self, i: int, stop: int, owner: Node, scope: str, inside: str | None) -> int:
        """One declaration at i within owner; returns the place after it."""
        first, modifiers, decorators = self.toks[i], [], []
        while i < stop:
            t = self.toks[i].text
            if t == "@" and i + 1 < stop and self.toks[i + 1].text != "interface":
                j = i + 2
                while j + 1 < stop and self.toks[j].text == ".":
                    j += 2
                name = self.toks[j - 1].text
                if j < stop and self.toks[j].text == "(":
                    end = self._match(j, "(", ")")
                    name += "".join(x.text for x in self.toks[j : end + 1])
                    j = end + 1
                decorators.append(name)
                i = j
            elif t in _MODIFIERS:
                modifiers.append(t)
                i += 1
            else:
                break
        if i >= stop:
            return stop
        doc = self.comments.get((first.line, first.column))
        doc = clean_comment(doc) if doc else None
        t = self.toks[i]
        if t.text in (";", "}", ")"):
            return i + 1
        if t.text == "@" and i + 1 < stop and self.toks[i + 1].text == "interface":
            i, t = i + 1, Token("interface", t.line, t.column)
        if t.text in _TYPES and i + 1 < stop and re.match(r"[A-Za-z_$]", self.toks[i + 1].text):
            return self._type(i, stop, owner, scope, first, doc, modifiers, decorators)
        if t.text == "{":
            return self._match(i, "{", "}") + 1
        # a method or field: look for what ends its head
        j, depth = i, 0
        while j < stop:
            x = self.toks[j].text
            depth += (x == "<") - (x == ">")
            if depth <= 0 and x in ("(", "=", ";", "{", ",") or x in ("{", ";"):
                break
            j += 1
        if j >= stop:
            return stop
        if self.toks[j].text == "(" and j > i:
            return self._method(i, j, stop, owner, scope, first, doc, modifiers, decorators, inside)
        if self.toks[j].text in ("=", ";", ",") and j - 1 > i:
            return self._fields(i, j, stop, owner, scope, first, doc, modifiers, decorators)
        return (self._match(j, "{", "}") if self.toks[j].text == "{" else j) + 1

    def _type(self, i, stop, owner, scope, first, doc, modifiers, decorators) -> int:
        kind, name = _TYPES[self.toks[i].text], self.toks[i + 1].text
        j = i + 2
        heads: list[tuple[str, str, int]] = []
        what, angle, at = None, 0, j
        while at < stop and self.toks[at].text not in ("{", ";"):
            x = self.toks[at].text
            if x == "(":
                at = self._match(at, "(", ")")
            angle += (x == "<") - (x == ">")
            if not angle and x in ("extends", "implements"):
                what = x
            elif not angle and what and re.match(r"[A-Za-z_$]", x) and (at + 1 >= stop or self.toks[at + 1].text != "."):
                heads.append((what, x, self.toks[at].line))
            at += 1
        end = self._match(at, "{", "}") if at < stop and self.toks[at].text == "{" else at
        qualified = f"{scope}.{name}" if scope else name
        n = self._add(kind, name, qualified, first.line, self.toks[min(end, len(self.toks) - 1)].line, owner, doc, None, modifiers, decorators)
        for what, sup, line in heads:
            self.refs.append(Ref(n.id, sup, what, None, line, self.path))
        at += 1
        if kind == "enum":
            at = self._constants(at, end, n, qualified)
        fields = len(self.nodes)
        while at < end:
            at = max(at + 1, self._member(at, end, n, qualified, name))
        self._lombok(n, qualified, [f for f in self.nodes[fields:] if f.kind in ("field", "constant") and (n.id, f.id, "contains", f.start_line) in self.edges], decorators)
        return end + 1

    def _constants(self, at, end, owner, scope) -> int:
        while at < end and self.toks[at].text != ";":
            t = self.toks[at]
            if re.match(r"[A-Za-z_$]", t.text) and t.text not in _MODIFIERS:
                self._add("enum_member", t.text, f"{scope}.{t.text}", t.line, t.line, owner, modifiers=("public", "static"))
                at += 1
                for open_, close in (("(", ")"), ("{", "}")):
                    if at < end and self.toks[at].text == open_:
                        at = self._match(at, open_, close) + 1
            at += self.toks[at].text != ";" if at < end else 0
        return at + 1

    def _method(self, i, j, stop, owner, scope, first, doc, modifiers, decorators, inside) -> int:
        name = self.toks[j - 1].text
        close = self._match(j, "(", ")")
        returns = "".join(x.text for x in self.toks[i : j - 1]) or None
        k = close + 1
        while k < stop and self.toks[k].text not in ("{", ";"):
            k += 1
        end = self._match(k, "{", "}") if k < stop and self.toks[k].text == "{" else min(k, stop - 1)
        signature = name + "(" + " ".join(x.text for x in self.toks[j + 1 : close]) + ")"
        n = self._add("method", name, f"{scope}.{name}", first.line, self.toks[end].line, owner, doc, signature, modifiers, decorators, None if name == inside else returns)
        if end > k:
            self._body(k, end, n)
        return end + 1

    def _body(self, k, end, method) -> None:
        """Calls, creations and identifiers of a body, nested ones too."""
        for p in range(k, end):
            t = self.toks[p]
            if not re.match(r"[A-Za-z_$]", t.text):
                continue
            before = self.toks[p - 1].text
            if before == "new":
                self.refs.append(Ref(method.id, t.text, "instantiates", None, t.line, self.path))
            elif p + 1 < end and self.toks[p + 1].text == "(" and t.text not in _NO_CALLS:
                receiver = self.toks[p - 2].text if before == "." else None
                receiver = receiver if receiver is None or re.match(r"[A-Za-z_$]", receiver) else "()"
                self.refs.append(Ref(method.id, t.text, "calls", receiver, t.line, self.path))
            elif before not in (".", "@") and t.text not in _NO_CALLS | _MODIFIERS:
                self.refs.append(Ref(method.id, t.text, "reads", None, t.line, self.path))

    def _fields(self, i, j, stop, owner, scope, first, doc, modifiers, decorators) -> int:
        kind = "constant" if {"static", "final"} <= set(modifiers) else "field"
        typed = "".join(x.text for x in self.toks[i : j - 1])
        at = j
        names = [self.toks[j - 1]]
        while at < stop and self.toks[at].text != ";":
            x = self.toks[at].text
            if x in ("(", "{", "["):
                at = self._match(at, x, {"(": ")", "{": "}", "[": "]"}[x])
            elif x == "," and at + 2 < stop and self.toks[at + 2].text in (",", "=", ";"):
                names.append(self.toks[at + 1])
            at += 1
        for t in names:
            self._add(kind, t.text, f"{scope}.{t.text}", first.line if t is names[0] else t.line, self.toks[min(at, stop - 1)].line, owner, doc, f"{typed} {t.text}", modifiers, decorators, typed)
        return at + 1

    def _lombok(self, n, scope, fields, decorators) -> None:
        """Accessors that annotations bring about: on the class for all its fields, or on a field of a class that has one of them."""
        flags = _annotations(decorators)
        if not flags & (GETTERS | SETTERS | BUILDERS):
            return
        for f in fields:
            own = flags | _annotations(f.decorators)
            typed = f.return_type or "Object"
            if own & GETTERS:
                name = "is" + _up(f.name[2:]) if typed == "boolean" and f.name.startswith("is") else "get" + _up(f.name)
                self._add("method", name, f"{scope}.{name}", f.start_line, f.start_line, n, "Synthesized by Lombok @Getter", f"{name}()", ("public",), (), typed)
            if own & SETTERS:
                name = "set" + _up(f.name)
                self._add("method", name, f"{scope}.{name}", f.start_line, f.start_line, n, "Synthesized by Lombok @Setter", f"{name}({typed})", ("public",), (), "void")


# Annotations by what they bring about.
GETTERS, SETTERS, BUILDERS = {"Getter", "Data", "Value"}, {"Setter", "Data", "Value"}, {"Builder", "SuperBuilder"}


def _annotations(decorators: list[str]) -> set[str]:
    return {d.split("(")[0].split(".")[-1] for d in decorators}


def _up(name: str) -> str:
    return name[:1].upper() + name[1:]


_SKIPPED = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', re.S)
_SCRIPT = (
    ("class", re.compile(r"\bclass\s+(?P<n>[A-Za-z_$][\w$]*)(?:\s*<[^{>]*>)?(?:\s+extends\s+(?P<up>[\w$.]+)(?:<[^{]*?>)?)?(?:\s+implements\s+(?P<of>[^{]+))?")),
    ("function", re.compile(r"\bfunction\s*\*?\s*(?P<n>[A-Za-z_$][\w$]*)\s*(?:<[^(]*>)?\(")),
    ("function", re.compile(r"\b(?:const|let|var)\s+(?P<n>[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=\s*(?:async\s+)?(?:function\b|(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*(?::[^=]+)?=>)")),
    ("method", re.compile(r"(?:^|(?<=[\s;{}]))(?P<n>[A-Za-z_$][\w$]*)\s*\([^(){}]*\)\s*(?::\s*[^{};=]+)?\{")),
)
_TYPED = (
    ("interface", re.compile(r"\binterface\s+(?P<n>[A-Za-z_$][\w$]*)(?:\s*<[^{>]*>)?(?:\s+extends\s+(?P<of>[^{]+))?(?=\s*\{)")),
    ("type_alias", re.compile(r"\btype\s+(?P<n>[A-Za-z_$][\w$]*)\s*(?:<[^=]*>)?=(?!=)")),
    ("enum", re.compile(r"\benum\s+(?P<n>[A-Za-z_$][\w$]*)(?=\s*\{)")),
)
_IMPORTED = re.compile(r"""\bimport\s+(?:[^'";]*?\bfrom\s*)?['"](?P<a>[^'"\n]+)['"]|\brequire\s*\(\s*['"](?P<b>[^'"\n]+)['"]\s*\)""")
_CALL = re.compile(r"(?P<new>\bnew\s+)?(?:(?P<on>[A-Za-z_$][\w$]*)\s*\.\s*)?(?P<n>[A-Za-z_$][\w$]*)\s*\(")
_NO_METHODS = _NO_CALLS | {"function", "constructor", "class", "with", "await", "typeof", "async", "import", "require"}


def script(path: str, text: str) -> tuple[list[Node], list[tuple[str, str, str, int]], list[Ref]]:
    """Symbols of a JavaScript or TypeScript file, their containment, and what they import, extend, call and create. One walk over the text for each pattern."""
    language = "typescript" if path.endswith((".ts", ".tsx")) else "javascript"
    plain = _SKIPPED.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    breaks = [i for i, c in enumerate(plain) if c == "\n"]
    line_of = lambda at: bisect_left(breaks, at) + 1
    closes, opened = {}, []
    for m in re.finditer(r"[{}]", plain):
        if m[0] == "{":
            opened.append(m.start())
        elif opened:
            closes[opened.pop()] = m.start()
    opens = sorted(closes)

    def block(at: int, stop: int | None = None) -> int:
        """Where the block that opens next from at on, and before stop, closes; at without one."""
        k = bisect_left(opens, at)
        return closes[opens[k]] if k < len(opens) and (stop is None or opens[k] < stop) else at

    exported = {x for m in re.finditer(r"\bexport\s+(?:default\s+)?(?:abstract\s+)?(?:async\s+)?(?:class|function\s*\*?|const|let|var|interface|type|enum)\s+([A-Za-z_$][\w$]*)", plain) for x in m.groups()}
    exported |= {x for m in re.finditer(r"\bmodule\.exports([^\n]*)|\bexport\s*\{([^}]*)\}", plain) for g in m.groups() if g for x in re.findall(r"[A-Za-z_$][\w$]*", g)}
    nodes, edges, refs = [], [], []

    def put(kind, name, line, end, shown=None) -> Node:
        n = Node(node_id(path, kind, name, line), kind, name, shown or f"{path}.{name}", path, language, line, end, None, None, "PUBLIC", name in exported, False, False, [], None)
        nodes.append(n)
        return n

    file = put("file", path.rsplit("/", 1)[-1], 1, len(breaks) + 1, path)
    for m in _IMPORTED.finditer(text):
        if plain[m.start() : m.start() + 6].strip():  # not within a comment
            name = m["a"] or m["b"]
            n = put("import", name, line_of(m.start()), line_of(m.start()), name)
            edges += [(file.id, n.id, "contains", n.start_line), (file.id, n.id, "imports", n.start_line)]
    spans: list[tuple[int, int, Node, re.Match]] = []
    taken: set[int] = set()
    for kind, pattern in _SCRIPT + (_TYPED if language == "typescript" else ()):
        for m in pattern.finditer(plain):
            if m["n"] in _NO_METHODS or (kind == "method" and (m.start("n") in taken or plain[max(0, m.start("n") - 10) : m.start("n")].rstrip().endswith(("function", "new", ".")))):
                continue
            taken.add(m.start("n"))
            line = line_of(m.start("n"))
            tail = plain[m.end() - 1 :].split("\n", 1)[0] if kind == "function" and m[0].endswith(">") else "{"
            # an arrow without a block ends with its line
            end = block(m.end() - 1) if tail.rstrip().endswith("{") else m.end() - 1 + len(tail)
            spans.append((m.start("n"), max(end, m.end()), put(kind, m["n"], line, line_of(max(end, m.end() - 1))), m))
    spans.sort(key=lambda s: (s[0], -s[1]))
    stack: list[tuple[int, Node]] = []
    for start, end, n, m in spans:
        while stack and stack[-1][0] < start:
            stack.pop()
        edges.append((stack[-1][1].id if stack else file.id, n.id, "contains", n.start_line))
        stack.append((end, n))
        groups = m.groupdict()
        for what, names in (("extends", groups.get("up")), ("extends" if n.kind == "interface" else "implements", groups.get("of"))):
            refs += [Ref(n.id, x.strip().split("<")[0].split(".")[-1], what, None, n.start_line, path) for x in re.sub(r"<[^<>]*>", "", names or "").split(",") if x.strip()]
    stack, k = [], 0
    bodies = [s for s in spans if s[2].kind in ("function", "method")]
    heads = {s[0] for s in spans}
    for m in _CALL.finditer(plain):
        while k < len(bodies) and bodies[k][0] < m.start("n"):
            stack.append((bodies[k][1], bodies[k][2]))
            k += 1
        while stack and stack[-1][0] < m.start("n"):
            stack.pop()
        if stack and m["n"] not in _NO_METHODS and m.start("n") not in heads:
            refs.append(Ref(stack[-1][1].id, m["n"], "instantiates" if m["new"] else "calls", m["on"], line_of(m.start("n")), path))
    return nodes, edges, refs


NODE = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, docstring string, signature string, visibility string, is_exported boolean, is_static boolean, is_abstract boolean, decorators array<string>, return_type string"
_SCHEMA = f"path string, nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<source:string,target:string,kind:string,line:int>>, refs array<struct<from_node_id:string,reference_name:string,reference_kind:string,receiver:string,line:int,file_path:string>>, errors string"


def extract_one(path: str, text: str | None) -> tuple[list[Node], list[tuple[str, str, str, int]], list[Ref], str | None]:
    if text is None:
        return [], [], [], "no text"
    if path.endswith(".java"):
        try:
            r = _Reader(path, text)
            r.run()
        except (IndexError, RecursionError) as e:
            r.errors = str(e) or type(e).__name__
        return r.nodes, r.edges, r.refs, r.errors
    if path.endswith((".js", ".jsx", ".mjs", ".ts", ".tsx")):
        return *script(path, text), None
    return [], [], [], "no parser"


def extracted(files: DataFrame) -> DataFrame:
    """A row for each file (path, text): its nodes, edges, references, and what went wrong."""

    def run(frames):
        for f in frames:
            rows = [extract_one(p, t) for p, t in zip(f["path"], f["text"], strict=True)]
            yield pd.DataFrame({"path": f["path"], "nodes": [[n._asdict() for n in r[0]] for r in rows], "edges": [[dict(zip(("source", "target", "kind", "line"), e, strict=True)) for e in r[1]] for r in rows], "refs": [[x._asdict() for x in r[2]] for r in rows], "errors": [r[3] for r in rows]})

    return files.select("path", "text").mapInPandas(run, _SCHEMA)


def found_refs(extracts: DataFrame) -> DataFrame:
    """References of extracts, each once, with an id of their own."""
    r = extracts.select(F.explode("refs").alias("r")).select("r.*")
    return r.withColumn("ref_id", F.sha2(F.concat_ws("|", "from_node_id", "reference_name", "reference_kind", "receiver", "line"), 256)).dropDuplicates(["ref_id"])


def merged(extracts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and references of all extracts together."""
    nodes = extracts.select(F.explode("nodes").alias("n")).select("n.*")
    edges = extracts.select(F.explode("edges").alias("e")).select("e.*")
    return nodes, edges, found_refs(extracts)


def super_classes(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(source, target) of what classes extend, by import and name."""
    from tessera.operators import resolve

    up = resolve.resolved(refs.where("reference_kind = 'extends'"), nodes)
    return up.where("target IS NOT NULL").select(F.col("from_node_id").alias("source"), "target")


def resolved_edges(nodes: DataFrame, structure: DataFrame, refs: DataFrame, framework: DataFrame | None = None) -> DataFrame:
    """Edges (source, target, kind, line) of references: calls within the file, then of the class extended where they name super, then by framework, import and name; and what methods read of their file's members. structure has the containment.

    What several ways need is written once, so that no plan holds another's.
    """
    from tessera.operators import resolve

    nodes = cut(nodes.select("id", "kind", "name", "qualified_name", "file_path", "is_exported", "start_line"))
    refs = cut(refs.select("ref_id", "from_node_id", "reference_name", "reference_kind", "receiver", "line", "file_path"))
    methods = nodes.where("kind IN ('method', 'function')").select("id", "file_path", "name", "is_exported", F.col("start_line").alias("ord"))
    calls = refs.where("reference_kind = 'calls'").withColumnRenamed("reference_name", "name")
    inside = resolve.calls_in_file(calls.where("receiver IS NULL OR receiver <> 'super'").select("ref_id", "file_path", "name", "receiver"), methods)
    owners = structure.where("kind = 'contains'").select(F.col("source").alias("class_id"), F.col("target").alias("id"))
    near = inside
    if not calls.where("receiver = 'super'").isEmpty():
        upward = calls.where("receiver = 'super'").join(owners.withColumnRenamed("id", "from_node_id"), "from_node_id").select("ref_id", "class_id", "name")
        near = inside.unionByName(resolve.super_calls(upward, methods.join(owners, "id").select("id", "class_id", "name"), cut(super_classes(refs, nodes))))
    near = cut(near)
    called = calls.join(near.hint("merge"), "ref_id").select(F.col("from_node_id").alias("source"), "target", F.lit("calls").alias("kind"), "line")
    left = cut(refs.where("reference_kind <> 'reads'").join(near.select("ref_id").hint("merge"), "ref_id", "left_anti"))
    by_name = resolve.as_edges(resolve.resolved(left, nodes, framework)).select("source", "target", "kind", "line")
    members = nodes.where("kind IN ('field', 'constant', 'enum_member')").select("id", "file_path", "name")
    reads = resolve.field_references(refs.where("reference_kind = 'reads'").select(F.col("from_node_id").alias("source"), "file_path", F.col("reference_name").alias("name")), members)
    return called.unionByName(by_name).unionByName(reads.select("source", "target", F.lit("references").alias("kind"), F.lit(None).cast("int").alias("line")))


def graph_of(extracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of extracts with references resolved."""
    nodes, edges, refs = merged(extracts)
    return nodes, edges.unionByName(resolved_edges(nodes, edges, refs))
