"""Control-flow operators.

What stays inside a method is found a method at a time: its edges are gathered into one row, bounded by the method's size, and mapped in
Arrow batches, dominators and what follows from them with bit sets.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..tables import durable


def by_method(edges: DataFrame, blocks: DataFrame, fn, names: list[str]) -> DataFrame:
    """(method, *names): ``fn(nodes, edges)`` of every method, nodes sorted, the first being its entry."""
    nodes = blocks.groupBy("method").agg(F.sort_array(F.collect_set("block")).alias("nodes"))
    flow = edges.groupBy("method").agg(F.sort_array(F.collect_set(F.struct("src", "dst"))).alias("edges"))
    both = nodes.join(flow, "method", "left")

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(len(names) + 1)]
            for m, n, e in zip(*(c.to_pylist() for c in batch.columns)):
                for row in fn(n, [(x["src"], x["dst"]) for x in e or []]):
                    for col, v in zip(out, (m, *row)):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["method", *names])

    return both.select(F.col("method").cast("long"), "nodes", "edges").mapInArrow(run, "method long, " + ", ".join(f"{n} long" for n in names))


class Flow:
    """A method's graph with the dominators of what its entry reaches, as bit sets over the order of its nodes."""

    def __init__(self, nodes: list[int], edges: list[tuple[int, int]]):
        self.nodes, at = nodes, {n: i for i, n in enumerate(nodes)}
        self.succ: list[list[int]] = [[] for _ in nodes]
        self.pred: list[list[int]] = [[] for _ in nodes]
        for a, b in edges:
            self.succ[at[a]].append(at[b])
            self.pred[at[b]].append(at[a])
        self.order, seen, stack = [], {0}, [(0, iter(self.succ[0]))]
        while stack:
            x, rest = stack[-1]
            for y in rest:
                if y not in seen:
                    seen.add(y)
                    stack.append((y, iter(self.succ[y])))
                    break
            else:
                self.order.append(x)
                stack.pop()
        self.order.reverse()
        everything = sum(1 << i for i in self.order)
        self.dom = {i: everything for i in self.order}
        self.dom[0] = 1
        changed = True
        while changed:
            changed = False
            for i in self.order[1:]:
                new = everything
                for p in self.pred[i]:
                    if p in self.dom:
                        new &= self.dom[p]
                new |= 1 << i
                if new != self.dom[i]:
                    self.dom[i], changed = new, True

    def dominates(self, a: int, b: int) -> bool:
        return bool(self.dom[b] >> a & 1)

    def idom(self, i: int) -> int | None:
        above = [d for d in self.order if d != i and self.dominates(d, i)]
        return max(above, key=lambda d: self.dom[d].bit_count()) if above else None

    def frontier(self):
        for y in self.order:
            found = {x for p in self.pred[y] if p in self.dom for x in self.order if self.dominates(x, p) and not (x != y and self.dominates(x, y))}
            for x in found:
                yield x, y

    def loops(self) -> dict[int, set[int]]:
        """Header to the nodes of its natural loops."""
        out: dict[int, set[int]] = {}
        for t in self.order:
            for h in self.succ[t]:
                if self.dominates(h, t):
                    body, stack = out.setdefault(h, {h}), [t]
                    while stack:
                        x = stack.pop()
                        if x not in body:
                            body.add(x)
                            stack.extend(p for p in self.pred[x] if p in self.dom)
        return out


def dominators(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(method, dom, node) for nodes that the entry reaches."""

    def fn(nodes, e):
        f = Flow(nodes, e)
        return [(nodes[d], nodes[i]) for i in f.order for d in f.order if f.dominates(d, i)]

    return by_method(edges, blocks, fn, ["dom", "node"])


def immediate_dominators(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    def fn(nodes, e):
        f = Flow(nodes, e)
        return [(nodes[i], nodes[d]) for i in f.order if (d := f.idom(i)) is not None]

    return by_method(edges, blocks, fn, ["node", "idom"])


def dominance_frontier(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    def fn(nodes, e):
        return [(nodes[x], nodes[y]) for x, y in Flow(nodes, e).frontier()]

    return by_method(edges, blocks, fn, ["node", "frontier"])


def loop_members(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    def fn(nodes, e):
        return [(nodes[h], nodes[x]) for h, body in Flow(nodes, e).loops().items() for x in body]

    return by_method(edges, blocks, fn, ["header", "node"])


def block_kinds(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(method, block, kind): loop for headers, continue where a back edge leaves, break where a loop is left from within, if for other branches, normal."""
    loops = loop_members(edges, blocks)
    heads = loops.groupBy("method", F.col("header").alias("block")).agg(F.lit(True).alias("head"))
    e = edges.select(F.col("method").cast("long").alias("method"), "src", "dst").distinct()
    back = e.join(loops.select("method", F.col("header").alias("dst"), F.col("node").alias("src")), ["method", "src", "dst"]).groupBy("method", F.col("src").alias("block")).agg(F.lit(True).alias("back"))
    inside = e.join(loops.select("method", "header", F.col("node").alias("src")), ["method", "src"])
    leaves = inside.join(loops.select("method", "header", F.col("node").alias("dst")), ["method", "header", "dst"], "left_anti")
    leaves = leaves.where("src != header").groupBy("method", F.col("src").alias("block")).agg(F.lit(True).alias("leaves"))
    out = e.groupBy("method", F.col("src").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    all_ = blocks.select(F.col("method").cast("long").alias("method"), F.col("block").cast("long").alias("block")).distinct()
    for t in (heads, back, leaves, out):
        all_ = all_.join(t, ["method", "block"], "left")
    kind = F.when(F.col("head"), "loop").when(F.col("back"), "continue").when(F.col("leaves"), "break").when(F.col("n") > 1, "if").otherwise("normal")
    return all_.select("method", "block", kind.alias("kind"))


def cfg_reachable(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(method, block) that the first block of the method reaches: a walk over each method's edges, which lie in one row."""

    def fn(nodes, e):
        after: dict = {}
        for a, b in e:
            after.setdefault(a, []).append(b)
        seen, todo = {nodes[0]}, [nodes[0]]
        while todo:
            for y in after.get(todo.pop(), ()):
                if y not in seen:
                    seen.add(y)
                    todo.append(y)
        return [(x,) for x in seen]

    return by_method(edges, blocks, fn, ["block"])


def next_statements(stmts: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, stmt, next): the one after it in its block, or the first of each block after."""
    w = Window.partitionBy("method", "block").orderBy("idx")
    s = stmts.withColumn("next", F.lead("stmt").over(w))
    first = stmts.groupBy("method", F.col("block").alias("dst")).agg(F.min_by("stmt", "idx").alias("next"))
    last = s.where("next is null").select("method", F.col("block").alias("src"), "stmt")
    over = last.join(edges, ["method", "src"]).join(first, ["method", "dst"]).select("method", "stmt", "next")
    return s.where("next is not null").select("method", "stmt", "next").unionByName(over)


def local_def_use(stmts: DataFrame) -> DataFrame:
    """(method, block, use, def, name): each use with the nearest definition of its name before it in the block, null if none."""
    w = Window.partitionBy("method", "block", "name").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    s = stmts.withColumn("def", F.last(F.when(F.col("is_def"), F.col("stmt")), ignorenulls=True).over(w))
    return s.where("not is_def").select("method", "block", F.col("stmt").alias("use"), "def", "name")


def global_def_use(stmts: DataFrame, edges: DataFrame) -> DataFrame:
    """(method, use, def, name): definitions that reach each use, within its block or along blocks that do not define the name.

    Inside a block a window finds the nearest definition; between blocks a method's last definitions by block flow over its edges, which
    lie in one row with them, to the blocks that use the name before they define it.
    """
    local = local_def_use(stmts)
    gen = stmts.where("is_def").groupBy("method", "block", "name").agg(F.max_by("stmt", "idx").alias("def"))
    open_ = durable(local.where("def is null").drop("def"), "open-uses")
    wanted = open_.select("method", "name").distinct()
    gens = gen.join(wanted, ["method", "name"], "left_semi").groupBy("method").agg(F.collect_list(F.struct("block", F.col("name").cast("string").alias("name"), F.col("def").cast("long").alias("def"))).alias("gens"))
    flow = edges.groupBy("method").agg(F.collect_set(F.struct(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))).alias("edges"))
    both = gens.join(flow, "method").select("method", "gens", "edges")
    kind = both.schema["method"].dataType
    schema = StructType().add("method", kind).add("block", "long").add("name", "string").add("def", "long")

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(4)]
            for m, g, e in zip(*(c.to_pylist() for c in batch.columns)):
                after: dict = {}
                for x in e:
                    after.setdefault(x["src"], []).append(x["dst"])
                kills = {(x["block"], x["name"]) for x in g}
                todo = [(b, x["name"], x["def"]) for x in g for b in after.get(x["block"], ())]
                seen = set(todo)
                while todo:
                    b, name, d = todo.pop()
                    if (b, name) not in kills:
                        for y in after.get(b, ()):
                            if (y, name, d) not in seen:
                                seen.add((y, name, d))
                                todo.append((y, name, d))
                for b, name, d in seen:
                    for col, v in zip(out, (m, b, name, d)):
                        col.append(v)
            types = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["method", "block", "name", "def"])

    entering = both.mapInArrow(run, schema).withColumn("name", F.col("name").cast(stmts.schema["name"].dataType))
    far = open_.join(entering, ["method", "block", "name"]).select("method", "use", "def", "name")
    return local.where("def is not null").select("method", "use", "def", "name").unionByName(far)


def phi_sites(defs: DataFrame, frontier: DataFrame) -> DataFrame:
    """(method, name, block): where a name with (method, name, block) definitions needs a phi: the iterated dominance frontier, a method at a time."""
    by = frontier.groupBy("method").agg(F.collect_set(F.struct(F.col("node").cast("long").alias("node"), F.col("frontier").cast("long").alias("at"))).alias("frontier"))
    names = defs.groupBy("method", "name").agg(F.collect_set(F.col("block").cast("long")).alias("blocks")).groupBy("method").agg(F.collect_list(F.struct(F.col("name").cast("string").alias("name"), "blocks")).alias("names"))
    both = names.join(by, "method").select("method", "names", "frontier")
    schema = StructType().add("method", both.schema["method"].dataType).add("name", "string").add("block", "long")

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(3)]
            for m, n, f in zip(*(c.to_pylist() for c in batch.columns)):
                after: dict = {}
                for x in f:
                    after.setdefault(x["node"], []).append(x["at"])
                for x in n:
                    todo, seen = list(x["blocks"]), set()
                    while todo:
                        for y in after.get(todo.pop(), ()):
                            if y not in seen:
                                seen.add(y)
                                todo.append(y)
                    for y in seen:
                        for col, v in zip(out, (m, x["name"], y)):
                            col.append(v)
            types = [batch.schema.field(0).type, pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], ["method", "name", "block"])

    return both.mapInArrow(run, schema).withColumn("name", F.col("name").cast(defs.schema["name"].dataType))
