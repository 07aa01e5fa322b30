"""Syntax trees back to source text: two blanks a level, a statement a line; what is parsed again gives the same tree."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame

from .syntax import BINARY, Node, SyntaxFault, parse


def _words(*parts: str) -> str:
    return " ".join(p for p in parts if p)


class Printer:
    def __init__(self):
        self.lines: list[str] = []
        self.depth = 0

    def put(self, text: str) -> None:
        self.lines.append("  " * self.depth + text)

    def inside(self, nodes: list[Node], one=None) -> None:
        self.depth += 1
        for n in nodes:
            (one or self.statement)(n)
        self.depth -= 1

    def braced(self, n: Node) -> list[Node]:
        return n.kids if n.kind == "block" else [n]

    # --- expressions
    def e(self, n: Node, least: int = -1) -> str:
        """``n``, in parentheses if it binds less than ``least``."""
        text, binds = self.bound(n)
        return f"({text})" if binds < least else text

    def list(self, nodes: list[Node]) -> str:
        return ", ".join(self.e(x, 0) for x in nodes)

    def bound(self, n: Node) -> tuple[str, int]:
        k, kids = n.kind, n.kids
        if k in ("literal", "name"):
            return "" if n.extra.get("hole") else n.name, 20
        if k == "member":
            return f"{self.e(kids[0], 18)}.{n.name}", 19
        if k == "element":
            return f"{self.e(kids[0], 18)}[{self.e(kids[1])}]", 19
        if k == "call":
            held = n.extra.get("body")
            return f"{self.e(kids[0], 18)}({self.list(kids[1:])})" + (" " + self.body(held) if held is not None else ""), 19
        if k == "new":
            return f"new {self.e(kids[0], 19) if kids[0].kind != 'call' else '(' + self.e(kids[0]) + ')'}({self.list(kids[1:])})", 19
        if k == "array":
            return f"[{self.list(kids)}]", 20
        if k == "object":
            return "{ " + ", ".join(self.property(p) for p in kids) + " }" if kids else "{}", 20
        if k == "spread":
            return f"...{self.e(kids[0], 0)}", 0
        if k == "unary":
            if n.name == "yield":
                return _words("yield", *(self.e(x, 0) for x in kids)), 0
            return f"{n.name} {self.e(kids[0], 14)}", 14
        if k == "update":
            return f"{n.name} {self.e(kids[0], 15)}", 14
        if k == "cast":
            return f"{self.e(kids[0], 13)} as {n.name}", 8
        if k == "binary":
            p = BINARY[n.name]
            right = n.name == "**"
            return f"{self.e(kids[0], p + right if not (right and kids[0].kind == 'unary') else 20)} {n.name} {self.e(kids[1], p + (not right))}", p
        if k == "conditional":
            return f"{self.e(kids[0], 1)} ? {self.e(kids[1], 0)} : {self.e(kids[2], 0)}", 0
        if k == "assign":
            return f"{self.e(kids[0], 15)} {n.name} {self.e(kids[1], 0)}", 0
        if k == "comma":
            return f"{self.e(kids[0])}, {self.e(kids[1], 0)}", -1
        if k == "function":
            return self.function(n), 0
        if k == "class":
            inner = Printer()
            inner.depth = self.depth
            inner.class_(n)
            return "\n".join(inner.lines).lstrip(), 20
        raise ValueError(f"line {n.line}: {k}")

    def property(self, p: Node) -> str:
        return self.e(p, 0) if p.kind == "spread" else f"{p.name if p.name.isidentifier() else repr(p.name)}: {self.e(p.kids[0], 0)}"

    def params(self, nodes: list[Node]) -> str:
        def one(p: Node) -> str:
            x = p.extra
            out = _words(*x.get("modifiers", []), ("..." if x.get("rest") else "") + p.name)
            if x.get("optional") and p.value is None:
                out += "?"
            if x["type"] != "unknown":
                out += f": {x['type']}"
            return out + (f" = {self.e(p.value, 0)}" if p.value else "")

        return "(" + ", ".join(map(one, nodes)) + ")"

    def head(self, n: Node) -> str:
        generics = n.extra.get("type_params")
        returns = n.extra["returns"]
        return (f"<{', '.join(generics)}>" if generics else "") + self.params(n.kids) + (f": {returns}" if returns != "unknown" else "")

    def body(self, n: Node) -> str:
        inner = Printer()
        inner.depth = self.depth
        inner.inside(n.kids)
        return "{\n" + "\n".join([*inner.lines, "  " * self.depth + "}"])

    def function(self, n: Node) -> str:
        mods = _words(*(m for m in n.extra["modifiers"] if m == "async"))
        if n.name is None:
            return _words(mods, self.head(n) + " => " + self.body(n.value))
        return _words(mods, "function", n.name + self.head(n), self.body(n.value))

    # --- statements
    def statement(self, n: Node) -> None:
        rule = getattr(self, "on_" + n.kind.replace("-", "_"), None)
        if rule is None:
            text = self.e(n)
            self.put(f"({text});" if text.startswith(("{", "function", "class")) else text + ";")
        else:
            rule(n)

    def decorated(self, n: Node) -> str:
        for d in n.extra.get("decorators", []):
            self.put(f"@{d}")
        return _words(*n.extra.get("modifiers", []))

    def on_expression(self, n: Node) -> None:
        text = self.e(n.kids[0])
        self.put(f"({text});" if text.startswith(("{", "function", "class", "async function")) else text + ";")

    def on_block(self, n: Node) -> None:
        if n.kids:
            self.put("{")
            self.inside(n.kids)
            self.put("}")
        else:
            self.put(";")

    def variable_text(self, n: Node) -> str:
        one = lambda v: v.name + (f": {v.extra['type']}" if v.extra["type"] != "unknown" else "") + (f" = {self.e(v.value, 0)}" if v.value else "")
        return f"{n.name} " + ", ".join(map(one, n.kids))

    def on_variables(self, n: Node) -> None:
        self.put(_words(self.decorated(n), self.variable_text(n)) + ";")

    def on_function(self, n: Node) -> None:
        mods = [m for m in n.extra["modifiers"] if m in ("export", "default", "declare")]
        text = _words(*mods, "async" if "async" in n.extra["modifiers"] else "", "function " + (n.name or "") + self.head(n))
        self.put(f"{text} {self.body(n.value)}" if n.value else text + ";")

    def class_(self, n: Node) -> None:
        x = n.extra
        mods = self.decorated(n)
        generics = f"<{', '.join(x['type_params'])}>" if x.get("type_params") else ""
        up = "".join(f" {word} {', '.join(x[word])}" for word in ("extends", "implements") if x.get(word))
        self.put(_words(mods, "struct" if x.get("is_struct") else x["origin"], (n.name or "") + generics).rstrip() + up + " {")
        enum = x["origin"] == "enum"
        self.inside(n.kids, (lambda f: self.put(f.name + (f" = {self.e(f.value, 0)}" if f.value else "") + ",")) if enum else self.member)
        self.put("}")

    on_class = class_

    def member(self, n: Node) -> None:
        mods = self.decorated(n)
        name = n.name
        if n.kind == "field":
            x = n.extra
            text = _words(mods, name + ("?" if x["optional"] else "")) + (f": {x['type']}" if x["type"] != "unknown" else "")
            self.put(text + (f" = {self.e(n.value, 0)}" if n.value else "") + ";")
            return
        if name == "static-block":
            self.put("static " + self.body(n.value))
            return
        for tag, word in (("Get-", "get "), ("Set-", "set ")):
            name = word + name[4:] if name.startswith(tag) else name
        text = _words(mods, ("" if name == "call-signature" else name) + self.head(n))
        self.put(f"{text} {self.body(n.value)}" if n.value else text + ";")

    def on_namespace(self, n: Node) -> None:
        self.put(_words(self.decorated(n), f"namespace {n.name} {{"))
        self.inside(n.kids)
        self.put("}")

    def on_alias(self, n: Node) -> None:
        self.put(_words(*n.extra.get("modifiers", []), f"type {n.name} = {n.value}") + ";")

    def clause(self, found) -> str:
        return "{ " + ", ".join(f"{before} as {name}" if before else name for name, _, before in found) + " }"

    def on_import(self, n: Node) -> None:
        named = [c for c in n.value if c[1] == "NamedImports"]
        parts = [name for name, kind, _ in n.value if kind == "Identifier"] + [f"* as {name}" for name, kind, _ in n.value if kind == "NamespaceImport"] + ([self.clause(named)] if named else [])
        if n.value and n.value[0][1] == "EqualsImport":
            self.put(f"import {n.value[0][0]} = {n.name};")
        elif parts or not n.value:
            self.put(f"import {', '.join(parts) or '{}'} from '{n.name}';")
        else:
            self.put(f"import '{n.name}';")

    def on_export(self, n: Node) -> None:
        tail = f" from '{n.name}'" if n.name is not None else ""
        if n.kids:
            self.put(f"export default {self.e(n.kids[0], 0)};")
        elif n.value and n.value[0][1] == "NamespaceExport":
            self.put("export *" + ("" if n.value[0][0] == "*" else f" as {n.value[0][0]}") + tail + ";")
        else:
            self.put(f"export {self.clause(n.value)}{tail};")

    def on_if(self, n: Node) -> None:
        self.put(f"if ({self.e(n.kids[0])}) {{")
        self.inside(self.braced(n.kids[1]))
        if len(n.kids) > 2:
            self.put("} else {")
            self.inside(self.braced(n.kids[2]))
        self.put("}")

    def looped(self, head: str, body: Node) -> None:
        self.put(head + " {")
        self.inside(self.braced(body))
        self.put("}")

    def on_labeled(self, n: Node) -> None:
        self.put(f"{n.name}:")
        self.statement(n.kids[0])

    def on_while(self, n: Node) -> None:
        self.looped(f"while ({self.e(n.kids[0])})", n.kids[1])

    def on_do(self, n: Node) -> None:
        self.put("do {")
        self.inside(self.braced(n.kids[1]))
        self.put(f"}} while ({self.e(n.kids[0])});")

    def start(self, n: Node | None) -> str:
        return "" if n is None else self.variable_text(n) if n.kind == "variables" else self.e(n)

    def on_for(self, n: Node) -> None:
        a, b, c, body = n.kids
        self.looped(f"for ({self.start(a)}; {'' if b is None else self.e(b)}; {'' if c is None else self.e(c)})", body)

    def on_for_of(self, n: Node) -> None:
        self.looped(f"for ({self.start(n.kids[0])} {n.kind[4:]} {self.e(n.kids[1])})", n.kids[2])

    on_for_in = on_for_of

    def on_switch(self, n: Node) -> None:
        self.put(f"switch ({self.e(n.kids[0])}) {{")
        self.depth += 1
        for c in n.kids[1:]:
            self.put("default:" if c.value is None else f"case {self.e(c.value)}:")
            self.inside(c.kids[0].kids)
        self.depth -= 1
        self.put("}")

    def on_try(self, n: Node) -> None:
        self.put("try {")
        self.inside(n.kids[0].kids)
        if "catch" in n.extra:
            self.put(f"}} catch ({n.name}) {{" if n.name else "} catch {")
            self.inside(n.extra["catch"].kids)
        if "finally" in n.extra:
            self.put("} finally {")
            self.inside(n.extra["finally"].kids)
        self.put("}")

    def jump(self, n: Node) -> None:
        self.put(_words(n.kind, *filter(None, [n.name]), *(self.e(x) for x in n.kids)) + ";")

    on_return = on_throw = on_break = on_continue = jump


def print_source(tree: Node) -> str:
    """The text of a file's tree."""
    p = Printer()
    p.inside(tree.kids)
    return "\n".join(line[2:] if line.startswith("  ") else line for line in "\n".join(p.lines).split("\n")) + "\n"


def print_files(files: DataFrame) -> DataFrame:
    """(path, text): each (path, code) parsed and printed; null where it can't be parsed."""

    def one(code: str | None) -> str | None:
        try:
            return print_source(parse(code or ""))
        except (SyntaxFault, ValueError, RecursionError):
            return None

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([one(c) for c in batch.column(1).to_pylist()], pa.string())], ["path", "text"])

    return files.select("path", "code").mapInArrow(run, "path string, text string")


def dump(printed: DataFrame, out: str) -> None:
    """Write (path, text) as text, a folder a file, so that any number of files is written in parallel."""
    printed.where("text is not null").selectExpr("path as file", "text as value").write.mode("overwrite").partitionBy("file").text(out)
