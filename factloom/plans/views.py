"""Component trees of parsed projects: nodes resolved to components and builders, trees spliced together, and the state that nodes show."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.types import DECORATED_STATE
from ..operators.fixpoint import fixpoint
from ..sources.project import Program
from ..sources.views import BUILDER
from ..tables import durable
from .analysis import homes, visible_entities


def decorated(program: Program, table: str, kinds: list[str] | None = None) -> DataFrame:
    """(path, sig, class_sig, name, decorators): fields, methods or classes with a decorator, of those kinds if given, in the order they are written."""
    held = F.col("decorators") if kinds is None else F.filter("decorators", lambda d: d.isin(kinds))
    owner = F.col("sig") if table == "class" else F.col("class_sig")
    return program[table].select("path", "sig", owner.alias("class_sig"), "name", held.alias("decorators")).where("size(decorators) > 0")


def decorators_in_text(code, name):
    """The decorators that stand before a member's name in source text: for trees that have lost theirs."""
    found = F.regexp_extract(code, r"((?:@\w+(?:\([^)]*\))?\s*)+)(?:(?:public|private|protected|static|readonly|async)\s+)*\b" + name + r"\b\s*[?!:=(]", 1)
    return F.regexp_extract_all(found, F.lit(r"@(\w+)"), F.lit(1))


def field_types(program: Program) -> DataFrame:
    """(class_sig, field, type): what a component's fields are: their state decorators, joined, or their type."""
    state = F.filter("decorators", lambda d: d.isin(DECORATED_STATE))
    return program["field"].select("class_sig", F.col("name").alias("field"), F.when(F.size(state) > 0, F.array_join(state, "|")).otherwise(F.col("type")).alias("type"))


def trees(program: Program) -> DataFrame:
    """(class_sig, method_sig, name): the methods that show something: render methods of components and builders."""
    shown = program["view"].select("method_sig").distinct()
    component = program["class"].where("super_name in ('View', 'ViewPU')").select(F.col("sig").alias("class_sig"), F.lit(True).alias("component"))
    m = program["method"].select("class_sig", F.col("sig").alias("method_sig"), "name", F.array_contains("decorators", BUILDER).alias("builder")).join(shown, "method_sig", "left_semi")
    return m.join(component, "class_sig", "left").where("builder or component").select("class_sig", "method_sig", "name", "builder")


def view_nodes(program: Program) -> DataFrame:
    """(method_sig, class_sig, node, parent, ord, name, below, fields): nodes of each tree; ``below`` is the method whose tree hangs under a node.

    A component of the project becomes ``ViewPU``, under ``__Common__`` where it has attributes, a call of a builder ``Builder``, and one of a
    field that holds a builder ``BuilderParam``; calls of other methods are no nodes.
    """
    known = durable(trees(program), "trees")
    home = homes(program).select("class_sig", F.col("home").alias("scope"))
    v = program["view"].join(known.select("method_sig"), "method_sig", "left_semi").join(home, "class_sig")
    visible = visible_entities(program)
    classes = visible.where("kind = 'class'").select("path", "scope", F.col("name").alias("target"), F.col("entity").alias("shown"))
    renders = known.where("not builder").groupBy(F.col("class_sig").alias("shown")).agg(F.min("method_sig").alias("of_class"))
    functions = visible.where("kind = 'function'").select("path", "scope", F.col("name").alias("target"), F.col("entity").alias("function"))
    builders = known.where("builder")
    by_function = functions.join(builders.select(F.col("method_sig").alias("function")), "function")
    by_member = builders.select("class_sig", F.concat(F.lit("this."), "name").alias("target"), F.col("method_sig").alias("of_member"))
    params = decorated(program, "field", ["BuilderParam"]).select("class_sig", F.concat(F.lit("this."), "name").alias("target"), F.lit(True).alias("is_param"))
    both = v.join(classes, ["path", "scope", "target"], "left").join(renders, "shown", "left").join(by_function, ["path", "scope", "target"], "left").join(by_member, ["class_sig", "target"], "left").join(params, ["class_sig", "target"], "left")
    component = F.col("shown").isNotNull() & ~F.col("name").isin(BUILDER, "BuilderParam")
    below = F.when(component, F.col("of_class")).otherwise(F.coalesce("function", "of_member"))
    name = F.when(component, "ViewPU").when(F.col("is_param"), "BuilderParam").otherwise(F.col("name"))
    out = both.select("method_sig", "class_sig", "node", "parent", "ord", name.alias("name"), below.alias("below"), "fields", (component & (F.size("attributes") > 0)).alias("wrapped"))
    out = out.where("name <> 'Builder' or below is not null")
    # a wrapper takes the place of its component, which hangs below it under a number of its own
    plain = out.where("not wrapped").select("method_sig", "class_sig", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), "ord", "name", "below", "fields")
    outer = out.where("wrapped").select("method_sig", "class_sig", F.col("node").cast("long").alias("node"), F.col("parent").cast("long").alias("parent"), "ord", F.lit("__Common__").alias("name"), F.lit(None).cast("string").alias("below"), F.array().cast("array<string>").alias("fields"))
    inner = out.where("wrapped").select("method_sig", "class_sig", (F.col("node") + F.lit(1 << 32)).alias("node"), F.col("node").cast("long").alias("parent"), F.lit(0).alias("ord"), "name", "below", "fields")
    return plain.unionByName(outer).unionByName(inner)


def state_bindings(program: Program) -> DataFrame:
    """(class_sig, field, n_nodes): how many nodes show each state field of a component."""
    state = decorated(program, "field", DECORATED_STATE).select("class_sig", F.col("name").alias("field"))
    shown = view_nodes(program).select("class_sig", "method_sig", "node", F.explode("fields").alias("field"))
    return shown.join(state, ["class_sig", "field"], "left_semi").groupBy("class_sig", "field").agg(F.count_distinct("method_sig", "node").alias("n_nodes"))


def whole_trees(program: Program, most: int = 100) -> DataFrame:
    """(root, method_sig, depth): the trees that hang, directly or through others, in the tree of each method, at the least depth; a tree that holds itself is met once."""
    nodes = view_nodes(program)
    hangs = durable(nodes.where("below is not null").select("method_sig", "below").distinct(), "hangs")
    seed = nodes.select(F.col("method_sig").alias("root"), "method_sig").distinct()
    level = seed.withColumn("depth", F.lit(0))
    out, depth = [durable(level, "trees")], 0
    while depth < most:
        depth += 1
        known = out[0]
        for x in out[1:]:
            known = known.unionByName(x)
        new = out[-1].join(hangs, "method_sig").select("root", F.col("below").alias("method_sig")).distinct().join(known, ["root", "method_sig"], "left_anti").withColumn("depth", F.lit(depth))
        out.append(durable(new, "trees"))
        if out[-1].isEmpty():
            break
    known = out[0]
    for x in out[1:]:
        known = known.unionByName(x)
    return known


def paths(program: Program) -> DataFrame:
    """(method_sig, node, path): each node with the names from its tree's root down to it."""
    nodes = durable(view_nodes(program), "nodes")
    seed = nodes.where("parent is null").select("method_sig", "node", F.array("name").alias("path"))
    below = nodes.select("method_sig", F.col("node").alias("child"), F.col("parent").alias("node"), "name")
    return fixpoint(seed, lambda new, _: new.join(below, ["method_sig", "node"]).select("method_sig", F.col("child").alias("node"), F.concat("path", F.array("name")).alias("path")))
