"""Operators over statements and the locals they define and use.

Statements are (method, block, idx, def, op, args, line): ``op`` is the form of the right side and ``args`` its operands, so that a copy has
``op`` "name" and one operand. Locals are told apart by method and name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .fixpoint import closure, fixpoint

#: How many successors a statement has by its kind, where that is fixed; a switch has one for each case and one more without a default.
SUCCESSORS = {"if": 2, "return": 0, "return_void": 0, "throw": 0}
#: Forms that need a name of their own before another statement can take them as an operand.
COMPOUND = ["field", "element", "binary", "unary", "cast", "array", "object", "instance", "static", "new", "lengthof"]


def arg(i: int) -> Column:
    """The ``i``-th operand, null if there is none."""
    return F.get("args", F.lit(i))


def successor_count(kind: Column, args: Column) -> Column:
    """How many statements may follow one."""
    fixed = F.element_at(F.create_map(*[F.lit(x) for kv in SUCCESSORS.items() for x in kv]), kind)
    return F.when(kind == "switch", F.size(args) - 1 + F.when(F.array_contains(args, "default"), 0).otherwise(1)).otherwise(F.coalesce(fixed, F.lit(1)))


def is_branch(kind: Column) -> Column:
    return kind.isin("if", "switch")


def needs_temporary(op: Column) -> Column:
    """Whether a value takes more than one address, so that it is given a name before it is used."""
    return F.coalesce(op.isin(COMPOUND), F.lit(False))


def declaring_statements(stmts: DataFrame) -> DataFrame:
    """(method, name, block, idx): the last statement that defines each local; an earlier one is overwritten."""
    last = F.max(F.struct("block", "idx")).alias("at")
    return stmts.where("def is not null").groupBy("method", F.col("def").alias("name")).agg(last).select("method", "name", "at.block", "at.idx")


def using_statements(stmts: DataFrame) -> DataFrame:
    """(method, name, users): the statements that use each local, in order."""
    used = stmts.select("method", F.explode("uses").alias("name"), F.struct("block", "idx").alias("at"))
    return used.groupBy("method", "name").agg(F.sort_array(F.collect_set("at")).alias("users"))


def initial_values(stmts: DataFrame) -> DataFrame:
    """(method, name, op, args): what each local was first given, copies followed back to a value that is no local, or to a local that nothing declares.

    A local of a cycle of copies has none. Copies are followed by doubling, so a chain takes a number of rounds that grows with the
    logarithm of its length.
    """
    s = stmts.join(declaring_statements(stmts).withColumnRenamed("name", "def"), ["method", "def", "block", "idx"]).select("method", F.col("def").alias("name"), "op", "args")
    key = lambda m, n: F.struct(m.alias("m"), n.alias("n"))
    copies = s.where(F.col("op") == "name").select(key(F.col("method"), F.col("name")).alias("src"), key(F.col("method"), arg(0)).alias("dst"))
    far = closure(copies)
    ends = far.join(copies.select(F.col("src").alias("dst")), "dst", "left_anti").select(F.col("src.m").alias("method"), F.col("src.n").alias("name"), F.col("dst.n").alias("from"))
    values = s.where(~F.coalesce(F.col("op") == "name", F.lit(False)))
    given = ends.join(values.withColumnRenamed("name", "from"), ["method", "from"], "left")
    followed = given.select("method", "name", F.coalesce("op", F.lit("name")).alias("op"), F.coalesce("args", F.array("from")).alias("args"))
    return values.select("method", "name", "op", "args").unionByName(followed)


def bound_values(stmts: DataFrame) -> DataFrame:
    """(method, name, kind, value): all that a local's value is made of: itself, the locals its declaring statements use, in turn, and their constants and fields."""
    declared = stmts.join(declaring_statements(stmts).withColumnRenamed("name", "def"), ["method", "def", "block", "idx"])
    operands = declared.select("method", F.col("def").alias("name"), "op", "member", F.explode("args").alias("operand"))
    constant = F.col("operand").rlike(r"^(-?[0-9]|'|\"|`|(true|false|null|undefined)$)")
    locals_ = operands.where(~constant & ~F.col("op").isin("parameter", "this"))
    everyone = stmts.select("method", F.explode(F.concat("uses", F.when(F.col("def").isNull(), F.array().cast("array<string>")).otherwise(F.array("def")))).alias("name")).distinct()
    seed = everyone.select("method", "name", F.col("name").alias("value"))
    near = locals_.select("method", F.col("name").alias("value"), F.col("operand").alias("next")).distinct()
    reach = fixpoint(seed, lambda new, _: new.join(near, ["method", "value"]).select("method", "name", F.col("next").alias("value")))
    leaves = operands.where(constant & ~F.col("op").isin("parameter", "this")).select("method", F.col("name").alias("value"), F.lit("constant").alias("kind"), "operand")
    fields = operands.where("op = 'field'").select("method", F.col("name").alias("value"), F.lit("field").alias("kind"), F.concat_ws(".", "operand", "member").alias("operand"))
    far = reach.join(leaves.unionByName(fields), ["method", "value"]).select("method", "name", "kind", F.col("operand").alias("value"))
    return reach.select("method", "name", F.lit("local").alias("kind"), "value").unionByName(far).distinct()


def replace_uses(stmts: DataFrame, changes: DataFrame) -> DataFrame:
    """``stmts`` with operands replaced by (method, block, idx, old, new): every use of ``old`` in that statement becomes ``new``; definitions stay."""
    by = changes.groupBy("method", "block", "idx").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("__map"))
    both = stmts.join(by, ["method", "block", "idx"], "left")
    swap = lambda c: F.when(F.col("__map").isNull(), F.col(c)).otherwise(F.transform(c, lambda x: F.coalesce(F.try_element_at("__map", x), x)))
    return both.withColumn("uses", F.array_distinct(swap("uses"))).withColumn("args", swap("args")).drop("__map").select(*stmts.columns)


def insert_before(stmts: DataFrame, added: DataFrame) -> DataFrame:
    """``stmts`` with the rows of ``added``, each before the statement whose (method, block, idx) it has; several at one place keep the order of ``ord``."""
    old = stmts.withColumn("__late", F.lit(1)).withColumn("__ord", F.lit(0))
    new = added.withColumn("__late", F.lit(0)).withColumn("__ord", F.col("ord")).drop("ord")
    w = Window.partitionBy("method", "block").orderBy("idx", "__late", "__ord")
    both = old.unionByName(new.select(*old.columns))
    return both.withColumn("idx", (F.row_number().over(w) - 1).cast(stmts.schema["idx"].dataType)).drop("__late", "__ord")


def set_successor(edges: DataFrame, changes: DataFrame) -> DataFrame:
    """``edges`` (method, src, dst, ord) with the successor at (method, src, ord) of ``changes`` set to its ``dst``, new places included."""
    kept = edges.join(changes.select("method", "src", "ord"), ["method", "src", "ord"], "left_anti")
    return kept.select("method", "src", "dst", "ord").unionByName(changes.select("method", "src", "dst", "ord"))


def smallest_loops(members: DataFrame) -> DataFrame:
    """(method, node, header): of the loops (method, header, node) that a block lies in the one with the fewest blocks."""
    size = members.groupBy("method", "header").agg(F.count(F.lit(1)).alias("size"))
    return members.join(size, ["method", "header"]).groupBy("method", "node").agg(F.min_by("header", F.struct("size", "header")).alias("header"))


def numbered(stmts: DataFrame) -> DataFrame:
    """(method, block, idx, number, first_line): statements of a method numbered from 0 by block and place, with the line that its first one stands on."""
    w = Window.partitionBy("method").orderBy("block", "idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return stmts.select("method", "block", "idx", (F.row_number().over(w) - 1).alias("number"), F.first("line").over(whole).alias("first_line"))


def together(stmts: DataFrame) -> DataFrame:
    """``stmts`` with each constructor call right behind the statement that makes its object, in the order of the calls; all others keep their order.

    A call whose object is made in another block stays where it is.
    """
    made = stmts.where("op = 'new'").select("method", "block", F.col("def").alias("base"), F.col("idx").alias("__made"))
    calls = stmts.where("op = 'instance' and member = 'constructor'").select("method", "block", "idx", arg(0).alias("base"))
    first = calls.join(made, ["method", "block", "base"]).where("__made < idx").groupBy("method", "block", "idx").agg(F.max("__made").alias("__made"))
    both = stmts.join(first, ["method", "block", "idx"], "left")
    w = Window.partitionBy("method", "block").orderBy(F.coalesce("__made", "idx"), F.col("__made").isNotNull(), "idx")
    return both.withColumn("idx", (F.row_number().over(w) - 1).cast(stmts.schema["idx"].dataType)).drop("__made").select(*stmts.columns)
