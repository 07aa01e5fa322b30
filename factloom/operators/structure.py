"""Structured code from flow graphs: the kind of each block, and a method's statements as nested source text, a method at a time."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import OPPOSITE
from .cfg import Flow


class Method:
    """A method's graph with its loops and, for each block, the block where all its ways meet again."""

    def __init__(self, nodes: list[int], edges: list[tuple[int, int]], body: dict[int, list[dict]], heads: dict[int, str]):
        self.nodes, self.body, self.heads = nodes, body, heads
        self.flow = Flow(nodes, edges)
        at = {n: i for i, n in enumerate(nodes)}
        self.succ: dict[int, list[int]] = {i: [] for i in range(len(nodes))}
        for a, b in edges:
            self.succ[at[a]].append(at[b])
        self.loops = self.flow.loops()
        self.meet = self._meeting()

    def _meeting(self) -> dict[int, int | None]:
        """Immediate post-dominators, by dominators of the turned graph with one end."""
        n = len(self.nodes)
        turned = [(b, a) for a in self.succ for b in self.succ[a]] + [(-1, i) for i in range(n) if not self.succ[i]]
        back = Flow([-1, *range(n)], turned)
        out: dict[int, int | None] = dict.fromkeys(range(n))
        for i in back.order[1:]:
            d = back.idom(i)
            out[i - 1] = d - 1 if d else None
        return out

    def last(self, i: int) -> dict | None:
        return self.body[self.nodes[i]][-1] if self.body.get(self.nodes[i]) else None

    def around(self, i: int) -> int | None:
        """The header of the smallest loop that a block lies in."""
        return min((h for h in self.loops if i in self.loops[h]), key=lambda h: len(self.loops[h]), default=None)

    def behind(self, header: int | None) -> int | None:
        """Where a loop is left to from its test."""
        return None if header is None else next((x for x in self.succ[header] if x not in self.loops[header]), None)

    def leaves(self, i: int, header: int | None) -> bool:
        """Whether a block jumps out of the loop or back to its start, and does not fall through."""
        last = self.last(i)
        return header is not None and last is not None and (last["kind"] in ("return", "return_void", "throw") or last["kind"] == "goto" and bool(self.succ[i]) and self.succ[i][0] in (header, self.behind(header)))

    def join(self, i: int, header: int | None) -> int | None:
        """Where the arms of an ``if`` meet; an arm that leaves the loop meets none, so the other goes on."""
        if header is not None and len(self.succ[i]) == 2:
            yes, no = self.succ[i]
            if self.leaves(yes, header) != self.leaves(no, header):
                return no if self.leaves(yes, header) else yes
        return self.meet[i]

    def kind(self, i: int) -> str:
        last = self.last(i)
        if last is None:
            return "normal"
        if last["kind"] == "if":
            if i in self.loops:
                return self.heads.get(self.nodes[i]) or "while"
            return "if" if self.join(i, self.around(i)) in self.succ[i] else "if_else"
        if last["kind"] == "goto":
            inner = self.around(i)
            to = self.succ[i][0] if self.succ[i] else None
            return "continue" if inner is not None and to in self.loops[inner] else "break"
        return "normal"

    def kinds(self) -> list[tuple[int, str]]:
        return [(self.nodes[i], self.kind(i)) for i in self.flow.order]

    # --- text
    def text(self) -> list[str]:
        self.lines: list[str] = []
        self.done: set[int] = set()
        self.emit(0, None, None, 0)
        return self.lines

    def put(self, depth: int, text: str) -> None:
        self.lines.append("  " * depth + text)

    def test(self, s: dict, held: bool) -> str:
        """The condition of an ``if`` statement as it was written, or its opposite: the statement tests the opposite of the source."""
        a, b = s["args"]
        op = s["member"]
        if op == "==" and b == "0":
            return a if held else f"!{a}"
        return f"{a} {OPPOSITE[op] if held else op} {b}"

    def plain(self, i: int, depth: int, skip_last: bool) -> None:
        rows = self.body.get(self.nodes[i], [])
        for s in rows[:-1] if skip_last else rows:
            if s.get("op") in ("parameter", "this") or s["kind"] == "goto":
                continue
            self.put(depth, s["text"].replace("instanceinvoke ", "").replace("staticinvoke ", "").replace("<", "").replace(">(", "(") + ";" if s.get("op") in ("instance", "static") else s["text"] + ";")

    def emit(self, i: int | None, stop: int | None, loop: tuple[int, int | None] | None, depth: int) -> None:
        """Statements from block ``i`` up to ``stop``; ``loop`` is the innermost loop's header and the block behind it."""
        while i is not None and i != stop:
            if loop and i == loop[0] and i in self.done:
                return
            if i in self.done:
                return
            self.done.add(i)
            last = self.last(i)
            kind = last["kind"] if last else None
            if kind == "if" and i in self.loops:
                inside = self.loops[i]
                yes, no = (self.succ[i] + self.succ[i])[:2]
                held = yes in inside
                body, out = (yes, no) if held else (no, yes)
                first = len(self.body[self.nodes[i]]) > 1
                if first:
                    self.put(depth, "while (true) {")
                    self.plain(i, depth + 1, True)
                    self.put(depth + 1, f"if ({self.test(last, not held)}) break;")
                else:
                    self.put(depth, f"while ({self.test(last, held)}) {{")
                self.emit(body, i, (i, out), depth + 1)
                self.put(depth, "}")
                i = out
            elif kind == "if":
                self.plain(i, depth, True)
                meet, (yes, no) = self.join(i, loop[0] if loop else None), (self.succ[i] + self.succ[i])[:2]
                arms = []
                for to in (yes, no):
                    at = len(self.lines)
                    if to != meet:
                        self.branch(to, meet, loop, depth + 1)
                    arms.append(self.lines[at:])
                    del self.lines[at:]
                # an arm without statements is none
                held = bool(arms[0]) or not arms[1]
                self.put(depth, f"if ({self.test(last, held)}) {{")
                self.lines += arms[0] if held else arms[1]
                if held and arms[1]:
                    self.put(depth, "} else {")
                    self.lines += arms[1]
                self.put(depth, "}")
                i = meet
            elif kind == "switch":
                self.plain(i, depth, True)
                meet, cases = self.meet[i], last["args"][1:]
                self.put(depth, f"switch ({last['args'][0]}) {{")
                for case, to in zip(cases, self.succ[i]):
                    self.put(depth + 1, "default:" if case == "default" else f"case {case}:")
                    if to != meet:
                        later = next((x for x in self.succ[i][self.succ[i].index(to) + 1 :] if x != meet), None)
                        self.emit(to, meet if later is None or not self.reaches(to, later, meet) else later, loop, depth + 2)
                        if later is None or not self.reaches(to, later, meet):
                            self.put(depth + 2, "break;")
                self.put(depth, "}")
                i = meet
            else:
                self.plain(i, depth, False)
                to = self.succ[i][0] if self.succ[i] else None
                if kind == "goto" and loop:
                    if to == loop[1]:
                        self.put(depth, "break;")
                        return
                    if to == loop[0]:
                        self.put(depth, "continue;")
                        return
                i = to

    def branch(self, i: int, meet: int | None, loop, depth: int) -> None:
        if loop and i in loop and i != meet:
            self.put(depth, "continue;" if i == loop[0] else "break;")
        else:
            self.emit(i, meet, loop, depth)

    def reaches(self, a: int, b: int, stop: int | None) -> bool:
        seen, todo = {a}, [a]
        while todo:
            for y in self.succ[todo.pop()]:
                if y == b:
                    return True
                if y not in seen and y != stop:
                    seen.add(y)
                    todo.append(y)
        return False


def _by_method(blocks: DataFrame, edges: DataFrame, stmts: DataFrame, fn, schema: str, types: list) -> DataFrame:
    """``fn(Method)`` rows of each (path, method_sig)."""
    key = ["path", "method_sig"]
    nodes = blocks.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("block", "loop"))).alias("nodes"))
    flow = edges.groupBy(*key).agg(F.sort_array(F.collect_set(F.struct("src", "ord", "dst"))).alias("edges"))
    body = stmts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("block", "idx", F.to_json(F.struct("kind", "text", "def", "uses", "op", "member", "args")).alias("s")))).alias("body"))
    both = nodes.join(flow, key, "left").join(body, key, "left").select(*key, "nodes", "edges", "body")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(len(types) + 2)]
            for path, sig, n, e, b in zip(*(c.to_pylist() for c in batch.columns)):
                held: dict[int, list] = {}
                for x in b or []:
                    held.setdefault(x["block"], []).append(json.loads(x["s"]))
                for row in fn(Method([x["block"] for x in n], [(x["src"], x["dst"]) for x in e or []], held, {x["block"]: x["loop"] for x in n if x["loop"]})):
                    for col, v in zip(out, (path, sig, *row)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, [pa.string(), pa.string(), *types])], ["path", "method_sig", *names])

    return both.mapInArrow(run, f"path string, method_sig string, {schema}")


def block_types(blocks: DataFrame, edges: DataFrame, stmts: DataFrame) -> DataFrame:
    """(path, method_sig, block, kind): while, for, if, if_else, continue, break or normal, for the blocks that the entry reaches."""
    return _by_method(blocks, edges, stmts, Method.kinds, "block long, kind string", [pa.int64(), pa.string()])


def bodies(blocks: DataFrame, edges: DataFrame, stmts: DataFrame) -> DataFrame:
    """(path, method_sig, body): each method's statements as nested loops, branches and switches."""
    return _by_method(blocks, edges, stmts, lambda m: [("\n".join(m.text()),)], "body string", [pa.string()])


def dominator_order(blocks: DataFrame, edges: DataFrame, stmts: DataFrame) -> DataFrame:
    """(path, method_sig, block, number, depth): blocks in depth-first order of the dominator tree, children by number."""

    def walk(m: Method):
        children: dict[int, list[int]] = {}
        for i in m.flow.order:
            if (d := m.flow.idom(i)) is not None:
                children.setdefault(d, []).append(i)
        out, todo = [], [(0, 0)]
        while todo:
            i, depth = todo.pop()
            out.append((m.nodes[i], len(out), depth))
            todo += [(c, depth + 1) for c in sorted(children.get(i, []), key=lambda c: m.nodes[c], reverse=True)]
        return out

    return _by_method(blocks, edges, stmts, walk, "block long, number long, depth long", [pa.int64()] * 3)
