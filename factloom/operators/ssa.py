"""Static single assignment: phi placement, pruning and renaming, a method at a time."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cfg import Flow


def rename(nodes: list[int], edges: list[tuple[int, int]], stmts: list[tuple[int, int, str | None, list[str]]]) -> tuple[list, list]:
    """Versions ``name#k`` for one method, ``nodes`` sorted with its entry first.

    ``stmts`` are (block, idx, def, uses). Gives the statements of reached blocks with versions, and phis (block, def, [(pred, version)]).
    A name used without a definition before it keeps its plain form. A phi is placed where definitions meet and the name is live, and
    goes again if fewer than two predecessors bring a version.
    """
    f = Flow(nodes, edges)
    at = {n: i for i, n in enumerate(nodes)}
    body: dict[int, list] = {i: [] for i in range(len(nodes))}
    for s in sorted(stmts, key=lambda s: (s[0], s[1])):
        body[at[s[0]]].append(s)
    frontier: dict[int, set[int]] = {}
    for x, y in f.frontier():
        frontier.setdefault(x, set()).add(y)
    defs: dict[str, set[int]] = {}
    exposed: dict[int, set[str]] = {}
    killed: dict[int, set[str]] = {}
    for i in f.order:
        made: set[str] = set()
        exposed[i] = set()
        for _, _, d, uses in body[i]:
            exposed[i] |= {u for u in uses if u not in made}
            if d:
                made.add(d)
                defs.setdefault(d, set()).add(i)
        killed[i] = made
    live = {i: set(exposed[i]) for i in f.order}
    changed = True
    while changed:
        changed = False
        for i in reversed(f.order):
            new = live[i] | ({n for s in f.succ[i] for n in live[s]} - killed[i])
            if new != live[i]:
                live[i], changed = new, True
    phis: dict[int, dict[str, dict]] = {i: {} for i in f.order}
    for name, where in defs.items():
        todo = list(where)
        while todo:
            for y in frontier.get(todo.pop(), ()):
                if name not in phis[y] and name in live[y]:
                    phis[y][name] = {"args": {}}
                    if y not in where:
                        todo.append(y)
    children: dict[int, list[int]] = {}
    for i in f.order:
        if (d := f.idom(i)) is not None:
            children.setdefault(d, []).append(i)
    count: dict[str, int] = {}
    stack: dict[str, list[str]] = {}
    out = []

    def fresh(name: str) -> str:
        count[name] = count.get(name, -1) + 1
        stack.setdefault(name, []).append(f"{name}#{count[name]}")
        return stack[name][-1]

    work: list[tuple[str, int, list[str]]] = [("enter", 0, [])]
    while work:
        what, i, pushed = work.pop()
        if what == "leave":
            for name in pushed:
                stack[name].pop()
            continue
        mine: list[str] = []
        for name, phi in sorted(phis[i].items()):
            phi["def"] = fresh(name)
            mine.append(name)
        for block, idx, d, uses in body[i]:
            used = [stack[u][-1] if stack.get(u) else u for u in uses]
            made = None
            if d:
                made = fresh(d)
                mine.append(d)
            out.append((block, idx, made, used))
        for s in f.succ[i]:
            for name, phi in phis[s].items():
                if stack.get(name):
                    phi["args"][i] = stack[name][-1]
        work.append(("leave", i, mine))
        for c in reversed(children.get(i, [])):
            work.append(("enter", c, []))
    kept = [(nodes[i], p["def"], sorted((nodes[b], v) for b, v in p["args"].items())) for i in f.order for _, p in sorted(phis[i].items()) if len(p["args"]) > 1]
    return sorted(out, key=lambda s: (s[0], s[1])), kept


def to_ssa(edges: DataFrame, blocks: DataFrame, stmts: DataFrame) -> DataFrame:
    """(method, block, idx, def, uses, args): renamed statements of (method, block, idx, def, uses); phis have idx -1 and their ``args`` as block to version."""
    nodes = blocks.groupBy("method").agg(F.sort_array(F.collect_set("block")).alias("nodes"))
    flow = edges.groupBy("method").agg(F.sort_array(F.collect_set(F.struct("src", "dst"))).alias("edges"))
    body = stmts.groupBy("method").agg(F.collect_list(F.to_json(F.struct("block", "idx", "def", "uses"))).alias("body"))
    both = nodes.join(flow, "method", "left").join(body, "method", "left")
    schema = pa.schema([("method", pa.int64()), ("block", pa.int64()), ("idx", pa.int32()), ("def", pa.string()), ("uses", pa.list_(pa.string())), ("args", pa.map_(pa.int64(), pa.string()))])

    def run(batches):
        for batch in batches:
            rows = []
            for m, n, e, b in zip(*(c.to_pylist() for c in batch.columns)):
                made = [json.loads(x) for x in b or []]
                got, phis = rename(n, [(x["src"], x["dst"]) for x in e or []], [(x["block"], x["idx"], x.get("def"), x.get("uses", [])) for x in made])
                rows += [(m, block, -1, d, [v for _, v in args], args) for block, d, args in phis]
                rows += [(m, block, idx, d, uses, None) for block, idx, d, uses in got]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 6, schema)], schema=schema)

    return both.select(F.col("method").cast("long"), "nodes", "edges", "body").mapInArrow(run, "method long, block long, idx int, def string, uses array<string>, args map<long,string>")
