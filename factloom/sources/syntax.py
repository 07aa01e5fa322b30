"""A parser for a TypeScript-like language, in plain Python: regular-expression lexer, precedence-climbing expressions.

:func:`parse` gives a tree of :class:`Node`. Types are kept as rendered text. Anything malformed raises :class:`SyntaxFault` with its line.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class SyntaxFault(Exception):
    pass


@dataclass
class Node:
    kind: str
    line: int
    name: str | None = None
    value: object = None
    kids: list = field(default_factory=list)
    extra: dict = field(default_factory=dict)


# The language's operators with their precedence, assignments and words.
BINARY = {
    "??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8,
    "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12,
}
ASSIGN = {"=", "+=", "-=", "*=", "**=", "/=", "%=", "<<=", ">>=", ">>>=", "&=", "|=", "^=", "&&=", "||=", "??="}
MODIFIERS = {"public", "private", "protected", "static", "readonly", "abstract", "async", "export", "default", "declare", "override", "const"}
TOKEN = re.compile(
    r"""(?P<space>(?:\s+|//[^\n]*|/\*.*?\*/)+)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*')|(?P<number>0[xXbBoO][\da-fA-F_]+n?|(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?n?)"""
    r"""|(?P<name>[A-Za-z_$#\u0080-￿][\w$\u0080-￿]*)|(?P<op>>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|\*\*|<<|[{}()\[\];,<>+\-*/%&|^!~?:=.@])""",
    re.S,
)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")


def tokens(code: str) -> list[tuple[str, str, int, bool]]:
    """(kind, text, line, whether a line break is before it); template strings are one token."""
    out, at, line, fresh = [], 0, 1, True
    while at < len(code):
        c = code[at]
        if c == "`":
            end, depth = at + 1, 0
            while end < len(code) and (code[end] != "`" or depth):
                if code[end] == "\\":
                    end += 1
                elif code.startswith("${", end):
                    depth += 1
                elif code[end] == "}" and depth:
                    depth -= 1
                end += 1
            if end >= len(code):
                raise SyntaxFault(f"line {line}: template without end")
            kind, text = "template", code[at : end + 1]
        elif c == "/" and code[at + 1 : at + 2] not in "/*" and (not out or out[-1][0] == "op" and out[-1][1] not in (")", "]", "}") or out[-1][1] in ("return", "typeof", "case")) and (m := REGEX.match(code, at)):
            kind, text = "regex", m[0]
        elif m := TOKEN.match(code, at):
            kind, text = m.lastgroup, m[0]
        else:
            raise SyntaxFault(f"line {line}: unexpected {c!r}")
        if kind != "space":
            out.append((kind, text, line, fresh))
            fresh = False
        elif "\n" in text:
            fresh = True
        line += text.count("\n")
        at += len(text)
    out.append(("end", "", line, True))
    return out


class Parser:
    def __init__(self, code: str):
        self.toks, self.i = tokens(code), 0

    # --- tokens
    @property
    def text(self) -> str:
        kind, text, _, _ = self.toks[self.i]
        return "" if kind in ("string", "template", "regex", "end") else text

    @property
    def kind(self) -> str:
        return self.toks[self.i][0]

    @property
    def line(self) -> int:
        return self.toks[self.i][2]

    def ahead(self, n: int = 1) -> str:
        return self.toks[min(self.i + n, len(self.toks) - 1)][1]

    def take(self) -> str:
        text = self.toks[self.i][1]
        self.i += 1
        return text

    def eat(self, text: str) -> bool:
        if self.text == text:
            self.i += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.eat(text):
            raise SyntaxFault(f"line {self.line}: {text!r} expected, not {self.toks[self.i][1]!r}")

    def name(self) -> str:
        if self.kind not in ("name", "string", "number"):
            raise SyntaxFault(f"line {self.line}: a name expected, not {self.toks[self.i][1]!r}")
        return self.take()

    def end(self) -> None:
        if not self.eat(";") and self.text != "}" and self.kind != "end" and not self.toks[self.i][3]:
            raise SyntaxFault(f"line {self.line}: unexpected {self.toks[self.i][1]!r}")

    def attempt(self, rule):
        """``rule()``, or None with nothing taken if it doesn't fit here."""
        at = self.i
        try:
            return rule()
        except SyntaxFault:
            self.i = at
            return None

    def many(self, close: str, rule, separator: str = ",") -> list:
        out = []
        while not self.eat(close):
            out.append(rule())
            if not self.eat(separator):
                self.need(close)
                break
        return out

    # --- types, as text
    def type(self) -> str:
        self.eat("|")
        parts = [self.type_part()]
        while self.text in ("|", "&"):
            parts.append(self.take())
            parts.append(self.type_part())
        out = "".join(parts)
        if self.text == "extends" and "?" in (t[1] for t in self.toks[self.i : self.i + 12]):
            if (rest := self.attempt(self.conditional_type)) is not None:
                return out + rest
        return out

    def conditional_type(self) -> str:
        self.need("extends")
        test = self.type_part()
        self.need("?")
        yes = self.type()
        self.need(":")
        return f" extends {test} ? {yes} : {self.type()}"

    def type_part(self) -> str:
        if self.text in ("keyof", "typeof", "readonly", "unique", "infer"):
            return self.take() + " " + self.type_part()
        if self.text == "<":
            self.type_parameters()
            return self.function_type()
        if self.text == "(":
            arrow = self.attempt(self.function_type)
            if arrow is not None:
                return arrow
            self.need("(")
            out = "(" + self.type() + ")"
            self.need(")")
        elif self.text == "new":
            self.take()
            return "new " + self.function_type()
        elif self.eat("["):
            out = "[" + ", ".join(self.many("]", self.tuple_item)) + "]"
        elif self.text == "{":
            out = self.braces()
        elif self.kind in ("string", "number", "template"):
            out = self.take()
        elif self.eat("-"):
            out = "-" + self.take()
        else:
            out = self.name()
            while self.eat("."):
                out += "." + self.name()
            if out in ("asserts",) or self.text == "is":
                if self.eat("is"):
                    return f"{out} is {self.type()}"
            if self.text == "<":
                out += self.type_arguments()
        while self.text == "[" and not self.toks[self.i][3]:
            self.take()
            if self.eat("]"):
                out += "[]"
            else:
                out += "[" + self.type() + "]"
                self.need("]")
        return out

    def tuple_item(self) -> str:
        spread = "..." if self.eat("...") else ""
        if self.kind == "name" and self.ahead() in (":", "?"):
            label = self.name() + ("?" if self.eat("?") else "")
            if self.eat(":"):
                return f"{spread}{label}: {self.type()}"
            return spread + label
        return spread + self.type() + ("?" if self.eat("?") else "")

    def function_type(self) -> str:
        params = self.parameters()
        self.need("=>")
        return "(" + ", ".join(f"{p.name}: {p.extra['type']}" for p in params) + ") => " + self.type()

    def braces(self) -> str:
        """The text of a balanced pair of braces."""
        self.need("{")
        depth, out = 1, ["{"]
        while depth:
            if self.kind == "end":
                raise SyntaxFault(f"line {self.line}: '}}' expected")
            depth += {"{": 1, "}": -1}.get(self.text, 0)
            out.append(self.take())
        return " ".join(out)

    def type_arguments(self) -> str:
        self.need("<")
        return "<" + ", ".join(self.many(">", self.type)) + ">"

    def type_parameters(self) -> list[str]:
        def one() -> str:
            out = self.name()
            if self.eat("extends"):
                out += " extends " + self.type()
            if self.eat("="):
                out += " = " + self.type()
            return out

        return self.many(">", one) if self.eat("<") else []

    def annotation(self, default: str = "unknown") -> str:
        return self.type() if self.eat(":") else default

    # --- expressions
    def expression(self) -> Node:
        e = self.assignment()
        while self.text == ",":
            line = self.line
            self.take()
            e = Node("comma", line, kids=[e, self.assignment()])
        return e

    def assignment(self) -> Node:
        line = self.line
        if (arrow := self.attempt(self.arrow)) is not None:
            return arrow
        if self.text == "yield":
            self.take()
            self.eat("*")
            return Node("unary", line, "yield", kids=[] if self.text in (")", "]", "}", ";", ",") else [self.assignment()])
        left = self.binary(0)
        if self.eat("?"):
            yes = self.assignment()
            self.need(":")
            return Node("conditional", line, kids=[left, yes, self.assignment()])
        if self.text in ASSIGN:
            op = self.take()
            return Node("assign", line, op, kids=[left, self.assignment()])
        if self.text == ">" and self.ahead() in (">=", ">") and "".join(t[1] for t in self.toks[self.i : self.i + 3]).startswith((">>=", ">>>=")):
            op = ""
            while not op.endswith("="):
                op += self.take()
            return Node("assign", line, op, kids=[left, self.assignment()])
        return left

    def arrow(self) -> Node:
        line, mods = self.line, []
        if self.text == "async" and self.ahead() in ("(",) or self.text == "async" and self.toks[self.i + 1][0] == "name" and self.ahead(2) == "=>":
            mods.append(self.take())
        if self.kind == "name" and self.ahead() == "=>":
            params, returns = [Node("param", line, self.name(), extra={"type": "unknown", "optional": False})], "unknown"
        elif self.text in ("(", "<"):
            self.type_parameters()
            params = self.parameters()
            returns = self.annotation()
        else:
            raise SyntaxFault("no arrow")
        self.need("=>")
        if self.text == "{":
            body = self.block()
        else:
            e = self.assignment()
            body = Node("block", e.line, kids=[Node("return", e.line, kids=[e])])
        return Node("function", line, None, body, params, {"returns": returns, "modifiers": mods, "type_params": []})

    def operator(self) -> str | None:
        """The binary operator here; shifts are adjacent '>'s, which types need apart."""
        if self.text == ">":
            run = 1
            while run < 3 and self.ahead(run) == ">":
                run += 1
            return ">" * run if self.ahead(run) not in ("=", ">=") else (">" if run == 1 else None)
        return self.text if self.text in BINARY else None

    def binary(self, least: int) -> Node:
        left = self.unary()
        while True:
            line = self.line
            if self.text in ("as", "satisfies") and not self.toks[self.i][3]:
                self.take()
                left = Node("cast", line, self.type(), kids=[left])
                continue
            op = self.operator()
            if op is None or BINARY[op] < least or (op == "in" and self.no_in):
                return left
            self.i += len(op) if op.strip(">") == "" else 1
            right = self.binary(BINARY[op] + (op != "**"))
            left = Node("binary", line, op, kids=[left, right])

    no_in = False
    #: Inside the body of a component's method: calls may have blocks.
    views = False

    def unary(self) -> Node:
        line = self.line
        if self.text in ("!", "~", "+", "-", "typeof", "void", "delete", "await"):
            return Node("unary", line, self.take(), kids=[self.unary()])
        if self.text in ("++", "--"):
            return Node("update", line, self.take(), kids=[self.unary()])
        if self.text == "<" and (cast := self.attempt(self.angle_cast)) is not None:
            return cast
        e = self.postfix(self.primary())
        if self.text in ("++", "--") and not self.toks[self.i][3]:
            return Node("update", line, self.take(), kids=[e])
        return e

    def angle_cast(self) -> Node:
        line = self.line
        self.need("<")
        t = self.type()
        self.need(">")
        return Node("cast", line, t, kids=[self.unary()])

    def arguments(self) -> list[Node]:
        self.need("(")
        return self.many(")", self.spread)

    def spread(self) -> Node:
        line = self.line
        return Node("spread", line, kids=[self.assignment()]) if self.eat("...") else self.assignment()

    def generic_call(self) -> list[Node]:
        self.type_arguments()
        return self.arguments()

    def postfix(self, e: Node, calls: bool = True) -> Node:
        while True:
            line = self.line
            if self.eat("?."):
                if self.text == "(":
                    e = Node("call", line, kids=[e, *self.arguments()])
                elif self.eat("["):
                    e = Node("element", line, kids=[e, self.expression()])
                    self.need("]")
                else:
                    e = Node("member", line, self.name(), kids=[e])
            elif self.eat("."):
                e = Node("member", line, self.name(), kids=[e])
            elif self.text == "[":
                self.take()
                e = Node("element", line, kids=[e, self.expression()])
                self.need("]")
            elif self.text == "(" and calls:
                e = Node("call", line, kids=[e, *self.arguments()])
                if self.views and self.text == "{" and e.kids[0].kind == "name" and not self.toks[self.i][3]:
                    e.extra["body"] = self.block()
            elif self.text == "<" and calls and (args := self.attempt(self.generic_call)) is not None:
                e = Node("call", line, kids=[e, *args])
            elif self.text == "!" and not self.toks[self.i][3] and self.ahead() not in ("=", "=="):
                self.take()
            elif self.kind == "template":
                e = Node("call", line, kids=[e, Node("literal", line, self.take(), "string")])
            else:
                return e

    def primary(self) -> Node:
        line, kind = self.line, self.kind
        if kind == "template":
            return self.template(self.take(), line)
        if kind in ("string", "number", "regex"):
            return Node("literal", line, self.take(), kind)
        if self.eat("("):
            held, self.no_in = self.no_in, False
            e = self.expression()
            self.no_in = held
            self.need(")")
            return e
        if self.eat("["):
            return Node("array", line, kids=self.many("]", lambda: Node("literal", line, "undefined", "undefined", extra={"hole": True}) if self.text == "," else self.spread()))
        if self.text == "{":
            return self.object()
        if self.text == "new":
            self.take()
            made = self.postfix(self.primary(), calls=False)
            if self.text == "<":
                self.attempt(self.type_arguments)
            return Node("new", line, kids=[made, *(self.arguments() if self.text == "(" else [])])
        if self.text in ("function", "async") and (self.text == "function" or self.ahead() == "function"):
            return self.function([])
        if self.text == "class":
            return self.class_([], [])
        if self.text in ("true", "false", "null", "undefined"):
            text = self.take()
            return Node("literal", line, text, "boolean" if text in ("true", "false") else text)
        if kind == "name":
            return Node("name", line, self.take())
        raise SyntaxFault(f"line {line}: unexpected {self.toks[self.i][1]!r}")

    def template(self, text: str, line: int) -> Node:
        """A template string as a chain of additions."""
        parts, at = [], 1
        for m in re.finditer(r"\$\{((?:[^{}]|\{[^{}]*\})*)\}", text):
            if m.start() > at:
                parts.append(Node("literal", line, "'" + text[at : m.start()] + "'", "string"))
            inner = Parser(m[1])
            parts.append(inner.expression())
            at = m.end()
        if at < len(text) - 1 or not parts:
            parts.append(Node("literal", line, "'" + text[at:-1] + "'", "string"))
        e = parts[0]
        for p in parts[1:]:
            e = Node("binary", line, "+", kids=[e, p])
        return e

    def object(self) -> Node:
        line = self.line
        self.need("{")

        def one() -> Node:
            at = self.line
            if self.eat("..."):
                return Node("spread", at, kids=[self.assignment()])
            mods = []
            while self.text in ("async", "get", "set", "*") and self.ahead() not in (":", ",", "}", "("):
                mods.append(self.take())
            if self.eat("["):
                key = "[computed]"
                self.expression()
                self.need("]")
            else:
                key = self.name().strip("'\"")
            if self.text in ("(", "<"):
                return Node("property", at, key, kids=[self.callable(at, key, mods)])
            if self.eat(":"):
                return Node("property", at, key, kids=[self.assignment()])
            value = Node("name", at, key)
            if self.eat("="):
                value = Node("assign", at, "=", kids=[value, self.assignment()])
            return Node("property", at, key, kids=[value])

        return Node("object", line, kids=self.many("}", one))

    # --- functions and classes
    def parameters(self) -> list[Node]:
        self.need("(")

        def one() -> Node:
            self.decorators()
            line, mods = self.line, []
            while self.text in MODIFIERS and self.ahead() not in (",", ")", ":", "=", "?"):
                mods.append(self.take())
            rest = self.eat("...")
            name, tree = self.pattern() if self.text in ("{", "[") else (self.name(), None)
            optional = self.eat("?")
            type_ = self.annotation()
            start = self.assignment() if self.eat("=") else None
            return Node("param", line, name, start, extra={"type": type_, "optional": optional or start is not None, "rest": rest, "modifiers": mods, "pattern": tree})

        return self.many(")", one)

    def pattern(self) -> tuple[str, Node]:
        """A destructuring pattern: its text and its tree, that of the literal it looks like."""
        at = self.i
        tree = self.primary()
        return "".join(t[1] for t in self.toks[at : self.i]), tree

    def pattern_text(self) -> str:
        close, depth, out = {"{": "}", "[": "]"}[self.text], 0, ""
        while True:
            depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(self.text, 0)
            if self.kind == "end":
                raise SyntaxFault(f"line {self.line}: {close!r} expected")
            out += self.take()
            if not depth:
                return out

    def callable(self, line: int, name: str | None, mods: list[str]) -> Node:
        generics = self.type_parameters()
        params = self.parameters()
        returns = self.annotation()
        held, self.views = self.views, self.in_struct or self.built
        self.built = False
        body = self.block() if self.text == "{" else None
        self.views = held
        return Node("function", line, name, body, params, {"returns": returns, "modifiers": mods, "type_params": generics})

    #: Members of a component, and a method that a decorator makes a builder, have component bodies.
    in_struct = built = False

    def function(self, mods: list[str]) -> Node:
        line = self.line
        if self.eat("async"):
            mods = [*mods, "async"]
        self.need("function")
        self.eat("*")
        return self.callable(line, self.name() if self.kind == "name" else None, mods)

    def decorators(self) -> list[str]:
        out = []
        while self.eat("@"):
            text = self.name()
            while self.eat("."):
                text += "." + self.name()
            if self.text == "(":
                self.arguments()
            self.built |= text in ("Builder", "Extend", "Styles")
            out.append(text)
        return out

    def modifiers(self) -> list[str]:
        out = []
        while self.text in MODIFIERS and self.ahead() not in ("(", ":", "=", ";", "?", "}", ",", ")"):
            out.append(self.take())
        return out

    def class_(self, decorators: list[str], mods: list[str]) -> Node:
        line, kind = self.line, self.take()
        name = self.name() if self.kind == "name" and self.text not in ("extends", "implements") else None
        node = Node("class", line, name, extra={"origin": {"struct": "class"}.get(kind, kind), "is_struct": kind == "struct", "decorators": decorators, "modifiers": mods, "extends": [], "implements": [], "type_params": self.type_parameters()})
        while self.text in ("extends", "implements"):
            key = self.take()
            node.extra[key].append(self.heritage())
            while self.eat(","):
                node.extra[key].append(self.heritage())
        self.need("{")
        if kind == "enum":
            node.kids = self.many("}", lambda: Node("field", self.line, self.name(), self.assignment() if self.eat("=") else None, extra={"type": "number", "modifiers": ["static"], "decorators": [], "optional": False}))
            return node
        held, self.in_struct = self.in_struct, kind == "struct"
        while not self.eat("}"):
            if not (self.eat(";") or self.eat(",")):
                node.kids.append(self.member())
        self.in_struct = held
        return node

    def heritage(self) -> str:
        out = self.name()
        while self.eat("."):
            out += "." + self.name()
        if self.text == "<":
            self.type_arguments()
        return out

    def member(self) -> Node:
        decorators = self.decorators()
        line, mods = self.line, self.modifiers()
        decorators += self.decorators()
        if self.text == "static" and self.ahead() == "{":
            self.take()
            return Node("function", line, "static-block", self.block(), [], {"returns": "void", "modifiers": ["static"], "type_params": [], "decorators": []})
        accessor = ""
        if self.text in ("get", "set") and self.ahead() not in ("(", ":", "=", ";", "?", "<", "}"):
            accessor = {"get": "Get-", "set": "Set-"}[self.take()]
        self.eat("*")
        if self.text == "[":
            name = self.pattern_text()
        elif self.text in ("(", "<"):
            name = "call-signature"
        else:
            name = self.name().strip("'\"")
        optional = self.eat("?") or self.eat("!")
        if self.text in ("(", "<"):
            node = self.callable(line, accessor + name, mods)
            node.extra["decorators"] = decorators
            self.eat(";")
            return node
        type_ = self.annotation()
        start = self.assignment() if self.eat("=") else None
        if self.text != ",":
            self.end()
        return Node("field", line, name, start, extra={"type": type_, "modifiers": mods, "decorators": decorators, "optional": bool(optional)})

    # --- statements
    def block(self) -> Node:
        line = self.line
        self.need("{")
        out = Node("block", line)
        while not self.eat("}"):
            if self.kind == "end":
                raise SyntaxFault(f"line {self.line}: '}}' expected")
            out.kids.append(self.statement())
        return out

    def variables(self) -> Node:
        line, how = self.line, self.take()

        def one() -> Node:
            at = self.line
            name, tree = self.pattern() if self.text in ("{", "[") else (self.name(), None)
            self.eat("!")
            type_ = self.annotation()
            return Node("variable", at, name, self.assignment() if self.eat("=") else None, extra={"type": type_, "pattern": tree})

        kids = [one()]
        while self.eat(","):
            kids.append(one())
        return Node("variables", line, how, kids=kids)

    def statement(self) -> Node:
        line, word = self.line, self.text
        rule = getattr(self, f"on_{word}", None) if self.kind == "name" else None
        if word == "{":
            return self.block()
        if word == ";":
            self.take()
            return Node("block", line)
        if rule is not None and self.ahead() not in ("=", ".", ",") and not (word in ("type", "namespace", "module", "declare", "abstract", "struct") and self.toks[self.i + 1][0] != "name" and self.toks[self.i + 1][0] != "string"):
            return rule()
        if word == "@":
            decorators = self.decorators()
            mods = self.modifiers()
            return self.class_(decorators, mods) if self.text in ("class", "struct") else self.declared(self.statement(), decorators, mods)
        if word == "async" and self.ahead() == "function":
            return self.function([])
        if self.kind == "name" and self.ahead() == ":" and word not in ("case", "default"):
            label = self.take()
            self.take()
            return Node("labeled", line, label, kids=[self.statement()])
        e = self.expression()
        self.end()
        return Node("expression", line, kids=[e])

    def declared(self, node: Node, decorators: list[str], mods: list[str]) -> Node:
        node.extra.setdefault("decorators", []).extend(decorators)
        node.extra.setdefault("modifiers", []).extend(mods)
        return node

    def on_var(self) -> Node:
        if self.text == "const" and self.ahead() == "enum":
            self.take()
            return self.class_([], ["const"])
        out = self.variables()
        self.end()
        return out

    on_let = on_const = on_var

    def on_function(self) -> Node:
        out = self.function([])
        if out.value is None:
            self.eat(";")
        return out

    def on_class(self) -> Node:
        return self.class_([], [])

    on_interface = on_enum = on_struct = on_class

    def on_abstract(self) -> Node:
        self.take()
        return self.class_([], ["abstract"])

    def on_declare(self) -> Node:
        self.take()
        return self.declared(self.statement(), [], ["declare"])

    def on_namespace(self) -> Node:
        line = self.line
        self.take()
        name = self.name().strip("'\"")
        while self.eat("."):
            name += "." + self.name()
        body = self.block() if self.text == "{" else Node("block", line)
        return Node("namespace", line, name, kids=body.kids, extra={"modifiers": [], "decorators": []})

    on_module = on_namespace

    def on_type(self) -> Node:
        line = self.line
        self.take()
        name = self.name()
        self.type_parameters()
        self.need("=")
        out = Node("alias", line, name, self.type(), extra={"modifiers": []})
        self.end()
        return out

    def clause(self) -> list[tuple[str, str | None]]:
        def one():
            if self.text == "type" and self.ahead() not in (",", "}", "as"):
                self.take()
            name = self.name()
            return (self.name(), name) if self.eat("as") else (name, None)

        self.need("{")
        return self.many("}", one)

    def on_import(self) -> Node:
        if self.ahead() in ("(", "."):
            e = self.expression()
            self.end()
            return Node("expression", e.line, kids=[e])
        line, found = self.line, []
        self.take()
        if self.text == "type" and self.ahead() not in ("from", ",", "="):
            self.take()
        if self.kind == "string":
            found.append(("", "", None))
        else:
            if self.kind == "name":
                found.append((self.name(), "Identifier", None))
                if self.eat("="):
                    target = self.take()
                    if target == "require":
                        self.need("(")
                        target = self.take()
                        self.need(")")
                    self.end()
                    return Node("import", line, target.strip("'\""), [(found[0][0], "EqualsImport", None)])
                self.eat(",")
            if self.eat("*"):
                self.need("as")
                found.append((self.name(), "NamespaceImport", "*"))
            elif self.text == "{":
                found += [(n, "NamedImports", before) for n, before in self.clause()]
            self.need("from")
        spec = self.take().strip("'\"")
        self.end()
        return Node("import", line, spec, found)

    def on_export(self) -> Node:
        line = self.line
        self.take()
        if self.eat("*"):
            name = self.name() if self.eat("as") else "*"
            self.need("from")
            spec = self.take().strip("'\"")
            self.end()
            return Node("export", line, spec, [(name, "NamespaceExport", None)])
        if self.text == "{":
            found = [(n, "NamedExports", before) for n, before in self.clause()]
            spec = self.take().strip("'\"") if self.eat("from") else None
            self.end()
            return Node("export", line, spec, found)
        if self.eat("default"):
            if self.text in ("class", "function", "abstract", "interface", "async", "struct", "@"):
                return self.declared(self.statement(), [], ["export", "default"])
            e = self.assignment()
            self.end()
            return Node("export", line, None, [(e.name if e.kind == "name" else "default", "default", None)], [e])
        if self.eat("="):
            e = self.assignment()
            self.end()
            return Node("export", line, None, [(e.name or "default", "default", None)], [e])
        return self.declared(self.statement(), [], ["export"])

    def head(self) -> Node:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def on_if(self) -> Node:
        line = self.line
        self.take()
        test = self.head()
        yes = self.statement()
        return Node("if", line, kids=[test, yes, *([self.statement()] if self.eat("else") else [])])

    def on_while(self) -> Node:
        line = self.line
        self.take()
        return Node("while", line, kids=[self.head(), self.statement()])

    def on_do(self) -> Node:
        line = self.line
        self.take()
        body = self.statement()
        self.need("while")
        out = Node("do", line, kids=[self.head(), body])
        self.eat(";")
        return out

    def on_for(self) -> Node:
        line = self.line
        self.take()
        self.eat("await")
        self.need("(")
        start = None
        if self.text != ";":
            self.no_in = True
            start = self.variables() if self.text in ("var", "let", "const") else self.expression()
            self.no_in = False
            if self.text in ("of", "in"):
                how = self.take()
                over = self.expression()
                self.need(")")
                return Node("for-" + how, line, kids=[start, over, self.statement()])
        self.need(";")
        test = None if self.text == ";" else self.expression()
        self.need(";")
        step = None if self.text == ")" else self.expression()
        self.need(")")
        return Node("for", line, kids=[start, test, step, self.statement()])

    def on_switch(self) -> Node:
        line = self.line
        self.take()
        out = Node("switch", line, kids=[self.head()])
        self.need("{")
        while not self.eat("}"):
            at = self.line
            test = None if self.eat("default") else (self.need("case"), self.expression())[1]
            self.need(":")
            body = Node("block", at)
            while self.text not in ("case", "default", "}"):
                body.kids.append(self.statement())
            out.kids.append(Node("case", at, value=test, kids=[body]))
        return out

    def on_try(self) -> Node:
        line = self.line
        self.take()
        out = Node("try", line, kids=[self.block()])
        if self.eat("catch"):
            if self.eat("("):
                out.name = self.name()
                self.annotation()
                self.need(")")
            out.extra["catch"] = self.block()
        if self.eat("finally"):
            out.extra["finally"] = self.block()
        return out

    def jump(self) -> Node:
        line, word = self.line, self.take()
        value = None
        if not self.toks[self.i][3] and self.text not in (";", "}") and self.kind != "end":
            value = self.take() if word in ("break", "continue") else self.expression()
        self.end()
        label = value if isinstance(value, str) else None
        return Node(word, line, label, kids=[] if value is None or label else [value])

    on_return = on_throw = on_break = on_continue = jump


def parse(code: str) -> Node:
    """The tree of a source file."""
    p = Parser(code)
    out = Node("file", 1)
    while p.kind != "end":
        out.kids.append(p.statement())
    return out
