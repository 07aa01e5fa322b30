"""Syntax trees to program facts: entities, and method bodies as basic blocks of three-address statements.

Every operand of a statement is a name or a constant; deeper expressions go to temporaries ``$temp0``, ``$temp1``, ... in the order of
evaluation. Facts are (table, row) pairs whose columns are those of :data:`SCHEMAS`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from ..functions.types import OPPOSITE, binary_result
from .syntax import Node
from .views import shows, view_rows

SCHEMAS = {
    "namespace": "sig string, parent string, name string, is_exported boolean, line int",
    "class": "sig string, namespace string, owner string, name string, origin string, super_name string, interfaces array<string>, modifiers array<string>, decorators array<string>, type_params array<string>, is_exported boolean, line int",
    "method": "sig string, class_sig string, name string, sub_sig string, is_static boolean, is_abstract boolean, return_type string, modifiers array<string>, decorators array<string>, type_params array<string>, is_exported boolean, line int",
    "param": "method_sig string, ord int, name string, type string, optional boolean",
    "field": "sig string, class_sig string, name string, type string, is_static boolean, modifiers array<string>, decorators array<string>, initializer string, ord int, line int",
    "import": "clause string, kind string, from_spec string, name_before_as string, line int",
    "export": "clause string, kind string, from_spec string, name_before_as string, is_default boolean, line int",
    "block": "method_sig string, block int, loop string",
    "edge": "method_sig string, src int, dst int, ord int",
    "return": "method_sig string, block int, idx int, value string",
    # the right side of an assignment, or what a statement works on: its form, its member, operator or type, and its operands
    "stmt": "method_sig string, block int, idx int, kind string, text string, def string, uses array<string>, line int, op string, member string, args array<string>, left_base string, left_member string",
    # a node of a component tree: what it shows, its state fields, and the class or builder whose tree stands below it
    "view": "method_sig string, class_sig string, node int, parent int, ord int, name string, target string, fields array<string>, attributes array<string>, line int",
    "call": "method_sig string, block int, idx int, kind string, base string, callee string, args array<string>",
    "alloc": "method_sig string, block int, idx int, local string, class_name string",
    "local": "method_sig string, name string, type string",
    "error": "message string",
}
DEFAULT_CLASS, DEFAULT_METHOD = "_DEFAULT_CLASS", "_DEFAULT_METHOD"
#: Names that are constants of the language.
CONSTANTS = {"true", "false", "null", "undefined"}
NAME = re.compile(r"[A-Za-z_$][\w$]*")


class Body:
    """Lowers one method's body."""

    def __init__(self, sig: str, owner: Facts):
        self.sig, self.owner = sig, owner
        self.blocks: list[list[dict]] = [[]]
        self.edges: list[tuple[int, int]] = []
        self.at: int | None = 0
        self.temps = 0
        self.targets: list[tuple[int, int | None, str | None]] = []
        self.label: str | None = None
        #: Ends of labelled statements that are no loop or switch: only their label leaves them.
        self.plain: set[int] = set()
        #: (form, member, operands) of what :meth:`right` gave last.
        self.shape: tuple[str | None, str | None, tuple] = (None, None, ())
        self.types: dict[str, str] = {}
        self.calls: list[dict] = []
        self.allocs: list[dict] = []
        self.returned: list[dict] = []
        #: Blocks that loops begin with, and whether a step or a test alone leads round.
        self.heads: dict[int, str] = {}

    # --- blocks
    def new_block(self) -> int:
        self.blocks.append([])
        return len(self.blocks) - 1

    def go(self, src: int | None, dst: int) -> None:
        if src is not None and (src, dst) not in self.edges:
            self.edges.append((src, dst))

    def enter(self, block: int) -> None:
        self.at = block

    def emit(self, kind: str, text: str, line: int, define: str | None = None, uses: tuple = (), shape=(None, None, ()), left=(None, None)) -> tuple[int, int]:
        if self.at is None:
            self.at = self.new_block()  # nothing leads here
        stmts = self.blocks[self.at]
        names = [u for u in uses if u and NAME.match(u) and u not in CONSTANTS]
        op, member, args = shape
        stmts.append({"kind": kind, "text": text, "def": define, "uses": list(dict.fromkeys(names)), "line": line, "op": op, "member": member, "args": list(args), "left_base": left[0], "left_member": left[1]})
        return self.at, len(stmts) - 1

    def temp(self, text: str, line: int, uses: tuple, type_: str = "unknown", shape=(None, None, ())) -> str:
        name = f"$temp{self.temps}"
        self.temps += 1
        self.types[name] = type_
        self.emit("assign", f"{name} = {text}", line, name, uses, shape)
        return name

    # --- expressions: the name or constant that holds the value
    def value(self, e: Node) -> str:
        text, uses, simple = self.right(e)
        return text if simple else self.temp(text, e.line, uses, self.type_of(e), self.shape)

    def type_of(self, e: Node) -> str:
        if e.kind == "literal":
            return {"string": "string", "number": "number", "boolean": "boolean", "null": "null", "undefined": "undefined"}.get(e.value, "unknown")
        if e.kind == "name":
            return self.types.get(e.name, "unknown")
        if e.kind == "new" and e.kids[0].kind in ("name", "member"):
            return flat(e.kids[0])
        if e.kind == "cast":
            return e.name
        if e.kind == "array":
            kinds = {self.type_of(k) for k in e.kids}
            return f"({kinds.pop()})[]" if len(kinds) == 1 else "(unknown)[]"
        if e.kind == "unary":
            return {"typeof": "string", "!": "boolean", "void": "undefined"}.get(e.name) or self.type_of(e.kids[0] if e.kids else Node("literal", 0))
        if e.kind == "binary":
            return binary_result(e.name, *(self.type_of(k) for k in e.kids))
        return "unknown"

    def right(self, e: Node) -> tuple[str, tuple, bool]:
        """(text, operands, whether the text is a name or constant): the right side of an assignment; ``shape`` tells its form."""
        text, uses, simple = self.form(e)
        if simple:
            self.shape = ("name" if NAME.fullmatch(text) and text not in CONSTANTS else "const", None, (text,)) if e.kind != "function" else ("function", text, ())
        elif e.kind in ("member", "element", "binary", "unary", "cast", "array"):
            self.shape = ({"member": "field"}.get(e.kind, e.kind), e.name, uses)
        elif e.kind == "call":
            self.shape = (self.pending["kind"], self.pending["callee"], uses)
        else:
            self.shape = (e.kind, None, uses)
        return text, uses, simple

    def form(self, e: Node) -> tuple[str, tuple, bool]:
        k, line = e.kind, e.line
        if k == "literal":
            return e.name, (), True
        if k == "name":
            return e.name, (e.name,), True
        if k == "member":
            base = self.value(e.kids[0])
            return f"{base}.{e.name}", (base,), False
        if k == "element":
            base, index = self.value(e.kids[0]), self.value(e.kids[1])
            return f"{base}[{index}]", (base, index), False
        if k == "binary":
            if e.name in ("&&", "||", "??") and acts(e.kids[1]):
                return self.shortcut(e)
            a, b = self.value(e.kids[0]), self.value(e.kids[1])
            return f"{a} {e.name} {b}", (a, b), False
        if k == "unary":
            if not e.kids:
                return e.name, (), False
            a = self.value(e.kids[0])
            return (a, (a,), True) if e.name == "await" else (f"{e.name} {a}" if e.name.isalpha() else e.name + a, (a,), False)
        if k == "cast":
            a = self.value(e.kids[0])
            return f"<{e.name}>{a}", (a,), False
        if k == "spread":
            a = self.value(e.kids[0])
            return f"...{a}", (a,), True
        if k == "array":
            items = [self.value(x) for x in e.kids]
            return "[" + ", ".join(items) + "]", tuple(items), False
        if k == "call":
            return self.call(e)
        if k == "new":
            return self.new(e)
        if k == "function":
            name = self.owner.anonymous(e, self.sig)
            return name, (), True
        if k == "class":
            return self.owner.nested_class(e, self.sig), (), True
        if k == "object":
            parts, uses = [], []
            for p in e.kids:
                v = self.value(p.kids[0])
                uses.append(v)
                parts.append(f"...{v}" if p.kind == "spread" else f"{p.name}: {v}")
            return "{" + ", ".join(parts) + "}", tuple(uses), False
        if k == "assign":
            return self.assign(e)
        if k == "update":
            target = e.kids[0]
            one = Node("binary", line, e.name[0], kids=[target, Node("literal", line, "1", "number")])
            return self.assign(Node("assign", line, "=", kids=[target, one]))
        if k == "conditional":
            return self.choose(e)
        if k == "comma":
            self.value(e.kids[0])
            return self.right(e.kids[1])
        raise ValueError(f"line {line}: {k}")

    def shortcut(self, e: Node) -> tuple[str, tuple, bool]:
        """A logical operator whose right side does something: it is done only where the left side asks for it."""
        name = f"$temp{self.temps}"
        self.temps += 1
        text, uses, _ = self.right(e.kids[0])
        self.emit("assign", f"{name} = {text}", e.line, name, uses, self.shape)
        more, after = self.new_block(), self.new_block()
        held = Node("name", e.line, name)
        if e.name == "??":
            self.branch(Node("binary", e.line, "==", kids=[held, Node("literal", e.line, "null", "null")]), more, after)
        else:
            self.branch(held, *((more, after) if e.name == "&&" else (after, more)))
        self.enter(more)
        text, uses, _ = self.right(e.kids[1])
        self.emit("assign", f"{name} = {text}", e.line, name, uses, self.shape)
        self.go(self.at, after)
        self.enter(after)
        self.types[name] = self.type_of(e)
        return name, (name,), True

    def choose(self, e: Node) -> tuple[str, tuple, bool]:
        name = f"$temp{self.temps}"
        self.temps += 1
        yes, no, after = self.new_block(), self.new_block(), self.new_block()
        self.branch(e.kids[0], yes, no)
        for block, arm in ((yes, e.kids[1]), (no, e.kids[2])):
            self.enter(block)
            v, uses, _ = self.right(arm)
            self.emit("assign", f"{name} = {v}", e.line, name, uses, self.shape)
            self.go(self.at, after)
        self.enter(after)
        self.types[name] = self.type_of(e.kids[1])
        return name, (name,), True

    def call(self, e: Node) -> tuple[str, tuple, bool]:
        f, args = e.kids[0], [self.value(x) for x in e.kids[1:]]
        if f.kind == "member":
            base = self.value(f.kids[0])
            self.pending = {"kind": "instance", "base": base, "callee": f.name, "args": args}
            text, uses = f"instanceinvoke {base}.<{f.name}>({', '.join(args)})", (base, *args)
        else:
            name = f.name if f.kind == "name" else self.value(f)
            self.pending = {"kind": "static", "base": None, "callee": name, "args": args}
            text, uses = f"staticinvoke <{name}>({', '.join(args)})", (*args,)
        body = e.extra.get("body")
        where = (self.at if self.at is not None else len(self.blocks), len(self.blocks[self.at]) if self.at is not None else 0)
        self.calls.append({"block": where[0], "idx": where[1], **self.pending})
        if body is not None:
            # what a component holds runs after it is made
            made, shown = self.pending, self.temp(text, e.line, uses, "unknown", (self.pending["kind"], self.pending["callee"], uses))
            self.run(body)
            self.pending = made
            return shown, (shown,), True
        return text, uses, False

    def new(self, e: Node) -> tuple[str, tuple, bool]:
        name, line = flat(e.kids[0]), e.line
        args = [self.value(x) for x in e.kids[1:]]
        if name == "Array":
            return f"newarray ({', '.join(args)})", tuple(args), False
        at = self.temp(f"new {name}", line, (), name, ("new", name, ()))
        block, idx = self.at, len(self.blocks[self.at])
        self.allocs.append({"block": block, "idx": idx - 1, "local": at, "class_name": name})
        self.calls.append({"block": block, "idx": idx, "kind": "instance", "base": at, "callee": "constructor", "args": args})
        self.emit("invoke", f"instanceinvoke {at}.<constructor>({', '.join(args)})", line, None, (at, *args), ("instance", "constructor", (at, *args)))
        return at, (at,), True

    def assign(self, e: Node) -> tuple[str, tuple, bool]:
        target, source, op = *e.kids, e.name
        if op != "=":
            source = Node("binary", e.line, op[:-1], kids=[target, source])
        if target.kind in ("array", "object"):
            v = self.value(source)
            self.bind(target, Node("name", e.line, v))
            return v, (v,), True
        if target.kind == "name":
            text, uses, _ = self.right(source)
            self.types[target.name] = self.types.get(target.name) if self.types.get(target.name, "unknown") != "unknown" else self.type_of(source)
            self.emit("assign", f"{target.name} = {text}", e.line, target.name, uses, self.shape)
            return target.name, (target.name,), True
        left, uses, _ = self.right(target)
        place = (uses[0] if uses else None, target.name if target.kind == "member" else "[]")
        v = self.value(source)
        self.emit("assign", f"{left} = {v}", e.line, left, (*uses, v), ("name" if NAME.fullmatch(v) and v not in CONSTANTS else "const", None, (v,)), place)
        return v, (v,), True

    def bind(self, pattern: Node, source: Node) -> None:
        """Give the names of a pattern their parts of ``source``: by place or key, holes passed over, defaults where a part is undefined."""
        line = source.line
        if pattern.kind == "assign":
            v = Node("name", line, self.value(source))
            missing = Node("binary", line, "===", kids=[v, Node("literal", line, "undefined", "undefined")])
            source, pattern = Node("conditional", line, kids=[missing, pattern.kids[1], v]), pattern.kids[0]
        if pattern.kind not in ("array", "object"):
            self.types.setdefault(pattern.name or "", "unknown")
            self.assign(Node("assign", line, "=", kids=[pattern, source]))
            return
        v = Node("name", line, self.value(source))
        for i, x in enumerate(pattern.kids):
            if x.extra.get("hole"):
                continue
            if x.kind == "spread":
                part = v if pattern.kind == "object" else Node("call", line, kids=[Node("member", line, "slice", kids=[v]), Node("literal", line, str(i), "number")])
                self.bind(x.kids[0], part)
            elif pattern.kind == "object":
                self.bind(x.kids[0], Node("member", line, x.name, kids=[v]))
            else:
                self.bind(x, Node("element", line, kids=[v, Node("literal", line, str(i), "number")]))

    # --- conditions
    def branch(self, test: Node, yes: int, no: int) -> None:
        """Leave for ``yes`` or ``no``: the statement tests the opposite and its second successor is taken if that holds."""
        if test.kind == "binary" and test.name in ("&&", "||"):
            middle = self.new_block()
            self.branch(test.kids[0], *((middle, no) if test.name == "&&" else (yes, middle)))
            self.enter(middle)
            self.branch(test.kids[1], yes, no)
            return
        if test.kind == "unary" and test.name == "!":
            self.branch(test.kids[0], no, yes)
            return
        if test.kind == "binary" and test.name in OPPOSITE:
            a, b = self.value(test.kids[0]), self.value(test.kids[1])
            text, uses, op = f"if {a} {OPPOSITE[test.name]} {b}", (a, b), OPPOSITE[test.name]
        else:
            a = self.value(test)
            text, uses, op = f"if {a} == 0", (a, "0"), "=="
        self.emit("if", text, test.line, None, uses, ("binary", op, uses))
        self.go(self.at, yes)
        self.go(self.at, no)
        self.at = None

    # --- statements
    def run(self, s: Node) -> None:
        rule = getattr(self, "do_" + s.kind.replace("-", "_"), None)
        if rule is not None:
            rule(s)
        elif s.kind in ("function", "class", "namespace", "alias", "import", "export"):
            self.owner.declared_inside(s, self.sig)
        else:
            raise ValueError(f"line {s.line}: {s.kind}")

    def do_block(self, s: Node) -> None:
        for x in s.kids:
            self.run(x)

    def do_expression(self, s: Node) -> None:
        e = s.kids[0]
        if e.kind == "unary" and e.name == "await" and e.kids:
            e = e.kids[0]
        if e.kind == "unary" and e.name == "delete":
            v, uses, _ = self.right(e.kids[0])
            self.emit("delete", f"delete {v}", s.line, None, uses)
            return
        text, uses, simple = self.right(e)
        if not simple:
            self.emit("invoke" if e.kind == "call" else "expression", text, s.line, None, uses, self.shape)

    def do_variables(self, s: Node) -> None:
        for v in s.kids:
            source = v.value or Node("literal", v.line, "undefined", "undefined")
            if v.extra["type"] != "unknown" and v.extra.get("pattern") is None:
                self.types[v.name] = v.extra["type"]
            if v.extra.get("pattern") is not None:
                self.bind(v.extra["pattern"], source)
            else:
                self.types.setdefault(v.name, "unknown")
                self.assign(Node("assign", v.line, "=", kids=[Node("name", v.line, v.name), source]))

    def do_return(self, s: Node) -> None:
        if s.kids:
            v = self.value(s.kids[0])
            at = self.emit("return", f"return {v}", s.line, None, (v,), ("name" if NAME.fullmatch(v) and v not in CONSTANTS else "const", None, (v,)))
            self.returned.append({"block": at[0], "idx": at[1], "value": v})
        else:
            self.emit("return_void", "return", s.line)
        self.leave()

    def leave(self) -> None:
        for final in reversed(self.finals):
            self.go(self.at, final)
            break
        self.at = None

    finals: tuple = ()

    def do_labeled(self, s: Node) -> None:
        """A label names the loop or switch behind it; behind anything else ``break`` leaves that statement."""
        if s.kids[0].kind in ("for", "for-of", "for-in", "while", "do", "switch"):
            self.label = s.name
            self.run(s.kids[0])
            self.label = None
            return
        after = self.new_block()
        self.plain.add(after)
        self.targets.append((after, None, s.name))
        self.run(s.kids[0])
        self.targets.pop()
        self.go(self.at, after)
        self.enter(after)

    def open(self, out: int, again: int | None) -> None:
        """From here ``break`` goes to ``out`` and ``continue`` to ``again``, by the label that stands before, if any, as well."""
        self.targets.append((out, again, self.label))
        self.label = None

    def do_throw(self, s: Node) -> None:
        v = self.value(s.kids[0]) if s.kids else "undefined"
        self.emit("throw", f"throw {v}", s.line, None, (v,))
        if self.catches:
            self.go(self.at, self.catches[-1])
        self.at = None

    catches: tuple = ()

    def do_break(self, s: Node) -> None:
        self.emit("goto", "goto", s.line)
        to = next((out for out, _, label in reversed(self.targets) if (label == s.name if s.name else out not in self.plain)), None)
        if to is not None:
            self.go(self.at, to)
        self.at = None

    def do_continue(self, s: Node) -> None:
        self.emit("goto", "goto", s.line)
        to = next((again for _, again, label in reversed(self.targets) if again is not None and (not s.name or label == s.name)), None)
        if to is not None:
            self.go(self.at, to)
        self.at = None

    def do_if(self, s: Node) -> None:
        yes, after = self.new_block(), self.new_block()
        no = self.new_block() if len(s.kids) > 2 else after
        self.branch(s.kids[0], yes, no)
        self.enter(yes)
        self.run(s.kids[1])
        self.go(self.at, after)
        if len(s.kids) > 2:
            self.enter(no)
            self.run(s.kids[2])
            self.go(self.at, after)
        self.enter(after)

    def loop(self, test, step, body) -> None:
        label, self.label = self.label, None
        head, inside, after = self.new_block(), self.new_block(), self.new_block()
        again = self.new_block() if step else head
        self.heads[head] = "for" if step else "while"
        self.go(self.at, head)
        self.enter(head)
        if test is None:
            self.go(head, inside)
        else:
            test(inside, after)
        self.targets.append((after, again, label))
        self.enter(inside)
        body()
        self.go(self.at, again)
        self.targets.pop()
        if step:
            self.enter(again)
            step()
            self.go(self.at, head)
        self.enter(after)

    def do_while(self, s: Node) -> None:
        self.loop(lambda yes, no: self.branch(s.kids[0], yes, no), None, lambda: self.run(s.kids[1]))

    def do_do(self, s: Node) -> None:
        inside, check, after = self.new_block(), self.new_block(), self.new_block()
        self.go(self.at, inside)
        self.open(after, check)
        self.enter(inside)
        self.run(s.kids[1])
        self.go(self.at, check)
        self.targets.pop()
        self.enter(check)
        self.branch(s.kids[0], inside, after)
        self.enter(after)

    def do_for(self, s: Node) -> None:
        start, test, step, body = s.kids
        label, self.label = self.label, None
        if start is not None:
            self.run(start if start.kind == "variables" else Node("expression", start.line, kids=[start]))
        self.label = label
        self.loop((lambda yes, no: self.branch(test, yes, no)) if test else None, (lambda: self.run(Node("expression", step.line, kids=[step]))) if step else None, lambda: self.run(body))

    def each(self, s: Node, element: bool) -> None:
        start, over, body = s.kids
        line, label, self.label = s.line, self.label, None
        target = (start.kids[0].extra.get("pattern") or Node("name", line, start.kids[0].name)) if start.kind == "variables" else start
        held = self.value(over)
        size = self.temp(f"lengthof {held}", line, (held,), "number", ("lengthof", None, (held,)))
        index = self.temp("0", line, (), "number", ("const", None, ("0",)))
        name, number = (lambda n: Node("name", line, n)), Node("literal", line, "1", "number")

        def inside() -> None:
            self.bind(target, Node("element", line, kids=[name(held), name(index)]) if element else name(index))
            self.run(body)

        self.label = label
        self.loop(lambda yes, no: self.branch(Node("binary", line, "<", kids=[name(index), name(size)]), yes, no), lambda: self.assign(Node("assign", line, "+=", kids=[name(index), number])), inside)

    def do_for_of(self, s: Node) -> None:
        self.each(s, True)

    def do_for_in(self, s: Node) -> None:
        self.each(s, False)

    def do_switch(self, s: Node) -> None:
        label, self.label = self.label, None
        v = self.value(s.kids[0])
        self.label = label
        cases, after = s.kids[1:], self.new_block()
        tests = [self.value(c.value) if c.value is not None else "default" for c in cases]
        self.emit("switch", f"switch({v}) {{{', '.join(tests)}}}", s.line, None, (v, *(t for t in tests if t != "default")), ("switch", None, (v, *tests)))
        source, default = self.at, False
        self.open(after, None)
        before = None
        for c in cases:
            block = self.new_block()
            self.go(source, block)
            self.go(before, block)
            default |= c.value is None
            self.enter(block)
            self.run(c.kids[0])
            before = self.at
        self.targets.pop()
        self.go(before, after)
        if not default:
            self.go(source, after)
        self.enter(after)

    def do_try(self, s: Node) -> None:
        caught, final = s.extra.get("catch"), s.extra.get("finally")
        after = self.new_block()
        last = self.new_block() if final else after
        handler = self.new_block() if caught else last
        inside = self.new_block()
        self.go(self.at, inside)
        self.enter(inside)
        self.catches, self.finals = (*self.catches, handler), (*self.finals, *([last] if final else []))
        self.run(s.kids[0])
        self.catches = self.catches[:-1]
        self.go(self.at, handler)
        self.go(self.at, last)
        if caught:
            self.enter(handler)
            if s.name:
                self.types[s.name] = "unknown"
                self.emit("assign", f"{s.name} = caughtexception", s.line, s.name, (), ("caught", None, ()))
            self.run(caught)
            self.go(self.at, last)
        if final:
            self.finals = self.finals[:-1]
            self.enter(last)
            self.run(final)
            self.go(self.at, after)
        self.enter(after)

    def finish(self, line: int) -> None:
        """An implicit return, then blocks without statements are bridged and the rest numbered in order."""
        if self.at is not None and (self.blocks[self.at] or self.at == 0 or any(d == self.at for _, d in self.edges)):
            self.emit("return_void", "return", line)
        keep = [i for i, b in enumerate(self.blocks) if b]

        def through(b: int, seen: frozenset = frozenset()) -> list[int]:
            if self.blocks[b]:
                return [b]
            return list(dict.fromkeys(x for s, d in self.edges if s == b and d not in seen for x in through(d, seen | {b})))

        edges = [(s, x) for s, d in self.edges if self.blocks[s] for x in through(d)]
        number = {b: i for i, b in enumerate(keep)}
        self.order = number
        self.flow = list(dict.fromkeys((number[s], number[d]) for s, d in edges))


def acts(e: Node) -> bool:
    """Whether evaluating an expression may do more than give its value."""
    if e.kind in ("function", "class"):
        return False
    return e.kind in ("call", "new", "assign", "update") or any(acts(k) for k in e.kids if isinstance(k, Node))


def flat(e: Node) -> str:
    """A name or chain of members as text."""
    if e.kind == "member":
        return f"{flat(e.kids[0])}.{e.name}"
    return e.name or "%unknown"


class Facts:
    """Collects the facts of one file."""

    def __init__(self, project: str, path: str):
        self.file = f"@{project}/{re.sub(r'(\.d)?\.ts$', '', path)}: "
        self.rows: list[tuple[str, dict]] = []
        self.nested: dict[str, int] = {}

    def add(self, table: str, **row) -> None:
        self.rows.append((table, row))

    def of(self, tree: Node) -> list[tuple[str, dict]]:
        self.scope(tree.kids, self.file, "", None)
        return self.rows

    def scope(self, nodes: list[Node], prefix: str, joint: str, parent: str | None) -> None:
        """The members of a file or namespace; what is not a declaration makes the default method of its default class."""
        default = f"{prefix}{joint}{DEFAULT_CLASS}"
        rest: list[Node] = []
        self.class_row(default, parent or self.file, Node("class", 1, DEFAULT_CLASS, extra={"origin": "class"}), parent)
        for n in nodes:
            mods = n.extra.get("modifiers", [])
            if n.kind == "class":
                self.whole_class(n, f"{prefix}{joint}{n.name or 'default'}", parent or self.file, parent)
            elif n.kind == "function":
                self.method(n, default)
            elif n.kind == "namespace":
                sig = f"{prefix}{joint}{n.name}"
                self.add("namespace", sig=sig, parent=parent or self.file, name=n.name, is_exported="export" in mods, line=n.line)
                self.scope(n.kids, sig, ".", sig)
            elif n.kind == "import":
                for clause, kind, before in n.value:
                    self.add("import", clause=clause, kind=kind, from_spec=n.name, name_before_as=before, line=n.line)
            elif n.kind == "export":
                for clause, kind, before in n.value:
                    self.add("export", clause=clause, kind=kind, from_spec=n.name, name_before_as=before, is_default=kind == "default", line=n.line)
                if n.kids and n.kids[0].kind != "name":
                    rest.append(Node("expression", n.line, kids=[n.kids[0]]))
            elif n.kind != "alias":
                rest.append(n)
            if "export" in mods:
                names = [v.name for v in n.kids] if n.kind == "variables" else [n.name or "default"]
                for name in names:
                    self.add("export", clause=name, kind=n.kind, from_spec=None, name_before_as=None, is_default="default" in mods, line=n.line)
        self.method(Node("function", 1, DEFAULT_METHOD, Node("block", 1, kids=rest), [], {"returns": "void", "modifiers": [], "type_params": []}), default)

    def class_row(self, sig: str, owner: str, n: Node, namespace: str | None = None) -> None:
        x = n.extra
        up = x.get("extends", [])
        origin = x.get("origin", "class")
        self.add("class", sig=sig, namespace=namespace, owner=owner, name=n.name, origin=origin, super_name=up[0] if up and origin != "interface" else "ViewPU" if x.get("is_struct") else None, interfaces=[*x.get("implements", []), *(up if origin == "interface" else [])], modifiers=x.get("modifiers", []), decorators=x.get("decorators", []), type_params=x.get("type_params", []), is_exported="export" in x.get("modifiers", []), line=n.line)

    def whole_class(self, n: Node, sig: str, owner: str, namespace: str | None = None) -> None:
        self.class_row(sig, owner, n, namespace)
        fields = [k for k in n.kids if k.kind == "field"]
        for i, f in enumerate(fields):
            x = f.extra
            self.add("field", sig=f"{sig}.{f.name}", class_sig=sig, name=f.name, type=x["type"], is_static="static" in x["modifiers"], modifiers=x["modifiers"], decorators=x["decorators"], initializer=None if f.value is None else f.value.name if f.value.kind in ("literal", "name") else f.value.kind, ord=i, line=f.line)
        made = [m for m in n.kids if m.kind == "function"]
        if fields and n.extra.get("origin", "class") == "class" and not any(m.name == "constructor" for m in made):
            # fields get their values even where no constructor is written
            made.append(Node("function", n.line, "constructor", Node("block", n.line), [], {"returns": "unknown", "modifiers": [], "type_params": []}))
        for m in made:
            self.method(m, sig, fields if m.name == "constructor" else [])

    def method(self, n: Node, class_sig: str, fields: list[Node] = (), name: str | None = None) -> str:
        name = name or n.name or "default"
        sub = f"{name}({', '.join(dict.fromkeys(p.extra['type'] for p in n.kids))})"
        sig, x = f"{class_sig}.{sub}", n.extra
        mods = x.get("modifiers", [])
        self.add("method", sig=sig, class_sig=class_sig, name=name, sub_sig=sub, is_static="static" in mods, is_abstract="abstract" in mods or n.value is None, return_type=x["returns"], modifiers=mods, decorators=x.get("decorators", []), type_params=x.get("type_params", []), is_exported="export" in mods, line=n.line)
        for i, p in enumerate(n.kids):
            self.add("param", method_sig=sig, ord=i, name=p.name if p.extra.get("pattern") is None else f"$parameter{i}", type=p.extra["type"], optional=p.extra["optional"])
        if n.value is not None:
            self.body(n, sig, class_sig, fields)
        if shows(n, x.get("decorators", [])):
            for row in view_rows(n):
                self.add("view", method_sig=sig, class_sig=class_sig, **row)
        return sig

    def body(self, n: Node, sig: str, class_sig: str, fields: list[Node]) -> None:
        b = Body(sig, self)
        for i, p in enumerate(n.kids):
            name = p.name if p.extra.get("pattern") is None else f"$parameter{i}"
            b.types[name] = p.extra["type"]
            b.emit("assign", f"{name} = parameter{i}: {p.extra['type']}", n.line, name, (), ("parameter", p.extra["type"], (str(i),)))
        b.types["this"] = class_sig
        b.emit("assign", f"this = this: {class_sig}", n.line, "this", (), ("this", class_sig, ()))
        for i, p in enumerate(n.kids):
            if p.extra.get("pattern") is not None:
                b.bind(p.extra["pattern"], Node("name", n.line, f"$parameter{i}"))
        for f in fields:
            source = f.value or Node("literal", f.line, "undefined", "undefined")
            base = class_sig.rpartition(" ")[2].rpartition(".")[2] if "static" in f.extra["modifiers"] else "this"
            b.assign(Node("assign", f.line, "=", kids=[Node("member", f.line, f.name, kids=[Node("name", f.line, base)]), source]))
        b.run(n.value)
        b.finish(n.line)
        for block, number in b.order.items():
            self.add("block", method_sig=sig, block=number, loop=b.heads.get(block))
            for i, s in enumerate(b.blocks[block]):
                self.add("stmt", method_sig=sig, block=number, idx=i, **s)
        count: dict[int, int] = {}
        for s, d in b.flow:
            self.add("edge", method_sig=sig, src=s, dst=d, ord=count.get(s, 0))
            count[s] = count.get(s, 0) + 1
        for table, found in (("call", b.calls), ("alloc", b.allocs), ("return", b.returned)):
            for r in found:
                if r["block"] in b.order:
                    self.add(table, method_sig=sig, **{**r, "block": b.order[r["block"]]})
        for name, type_ in b.types.items():
            self.add("local", method_sig=sig, name=name, type=type_ or "unknown")

    def anonymous(self, n: Node, sig: str) -> str:
        """A function expression becomes a method of the default class, named after where it stands."""
        at = self.nested[sig] = self.nested.get(sig, -1) + 1
        name = n.name or f"AnonymousFunc${re.sub(r'^.*?([^.]*)\(.*$', r'\1', sig)}${at}"
        self.method(n, sig.rpartition("(")[0].rpartition(".")[0] or self.file + DEFAULT_CLASS, name=name)
        return name

    def nested_class(self, n: Node, sig: str) -> str:
        at = self.nested[sig] = self.nested.get(sig, -1) + 1
        name = n.name or f"AnonymousClass${at}"
        self.whole_class(Node("class", n.line, name, kids=n.kids, extra=n.extra), f"{self.file}{name}", self.file)
        return name

    def declared_inside(self, n: Node, sig: str) -> None:
        if n.kind == "function":
            self.anonymous(n, sig)
        elif n.kind == "class":
            self.nested_class(n, sig)


def facts_of(project: str, path: str, code: str) -> Iterator[tuple[str, dict]]:
    """The facts of a file; a file that can't be parsed gives one error row."""
    from .syntax import SyntaxFault, parse

    try:
        yield from Facts(project, path).of(parse(code))
    except (SyntaxFault, ValueError, RecursionError) as e:
        yield "error", {"message": str(e) or type(e).__name__}
