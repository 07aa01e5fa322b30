"""Name resolution: ranked lookups, visibility, imports, overwriting members and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import durable
from .fixpoint import closure, fixpoint, opened


def ranked_lookup(candidates: DataFrame, keys: list[str], rank: list[str]) -> DataFrame:
    """The first candidate of each key by ``rank``; partial minima, no sort."""
    rest = [c for c in candidates.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*rank))
    return candidates.groupBy(*keys).agg(best.alias("__b")).select(*keys, "__b.*")


def visible_names(scopes: DataFrame, own: DataFrame) -> DataFrame:
    """(scope, name, entity): what each scope sees.

    ``scopes`` are (scope, parent, is_exported), ``own`` (scope, name, entity, is_exported). A scope sees what it declares, what is
    exported from scopes inside it while each of them is exported, and what its ancestors see of their own or from inside them.
    """
    up = fixpoint(
        own.where("is_exported").select("scope", "name", "entity"),
        lambda new, _: new.join(scopes.where("is_exported and parent is not null"), "scope").select(F.col("parent").alias("scope"), "name", "entity"),
    )
    here = durable(own.select("scope", "name", "entity").unionByName(up).distinct(), "here")
    nodes = scopes.select(F.col("scope").alias("node")).unionByName(own.select(F.col("scope").alias("node"))).where("node is not null").distinct()
    above = durable(closure(scopes.where("parent is not null").select(F.col("scope").alias("src"), F.col("parent").alias("dst")), nodes), "above")
    # what a scope sees grows with the square of the scopes: names that the same topmost scopes hand down make one group
    one_way = above.join(above.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti")
    # a row's ancestors are few, what lies below it is not: rows look up whether one above them has the same
    over = here.join(one_way.withColumnRenamed("src", "scope"), "scope").join(here.withColumnRenamed("scope", "dst"), ["dst", "name", "entity"], "left_semi")
    top = here.where("scope is not null").join(over.select("scope", "name", "entity"), ["scope", "name", "entity"], "left_anti")
    sets = top.groupBy("name", "entity").agg(F.sort_array(F.collect_set("scope")).alias("tops"))
    sets = sets.select(*[F.xxhash64(F.lit(i), "tops").alias(f"g{i}") for i in (1, 2)], "tops", "name", "entity")
    handed = sets.select("g1", "g2", "tops").dropDuplicates(["g1", "g2"]).select("g1", "g2", F.explode("tops").alias("dst"))
    holders = above.join(handed, "dst").select(F.col("src").alias("scope"), "g1", "g2").distinct()
    return opened(holders, sets.drop("tops")).select("scope", "name", "entity").unionByName(here.where("scope is null"))


def shadowed_names(scopes: DataFrame, own: DataFrame) -> DataFrame:
    """(scope, name, entity): own names, and those of ancestors that no nearer scope declares."""
    taken = own.select("scope", "name").distinct()

    def step(new, _):
        down = new.join(scopes.select(F.col("scope").alias("child"), "parent"), F.col("scope") == F.col("parent"))
        return down.select(F.col("child").alias("scope"), "name", "entity").join(taken, ["scope", "name"], "left_anti")

    return fixpoint(own.select("scope", "name", "entity"), step)


def reexport_chase(imports: DataFrame, exports: DataFrame, most: int = 100, groups: list[Column] = ()) -> DataFrame:
    """(file, name, entity): what an import of ``name`` from ``file`` is, through aliases and re-exports; cycles end, the least entity of several wins.

    ``exports`` are (file, name, entity, from_file, from_name): a declared entity, or what another file exports under another name.
    ``groups`` are expressions over entities, kept as columns, of which each value has its own winner.
    """
    want = imports.select("file", "name", F.col("file").alias("at"), F.col("name").alias("as"))
    hop = exports.where("from_file is not null").select(F.col("file").alias("at"), F.col("name").alias("as"), "from_file", "from_name")
    seen = fixpoint(want, lambda new, _: new.join(hop, ["at", "as"]).select("file", "name", F.col("from_file").alias("at"), F.col("from_name").alias("as")), most)
    found = seen.join(exports.where("entity is not null").select(F.col("file").alias("at"), F.col("name").alias("as"), "entity"), ["at", "as"])
    return found.groupBy("file", "name", *groups).agg(F.min("entity").alias("entity"))


def last_member(members: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last declared member of each key; overloads and repeated names collapse."""
    rest = [c for c in members.columns if c not in keys]
    return members.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__b")).select(*keys, "__b.*")


def next_position(queries: DataFrame, marks: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """``queries`` with the ``value`` of the first mark of the same ``key`` at or after ``at``, null if none: an as-of join by one sort."""
    q = queries.withColumn("__q", F.lit(1)).withColumn(value, F.lit(None).cast(marks.schema[value].dataType))
    m = marks.select(*[F.col(c) if c in (key, at, value) else F.lit(None).alias(c) for c in [*queries.columns, value]], F.lit(0).alias("__q"))
    w = Window.partitionBy(key).orderBy(F.col(at).desc(), "__q").rowsBetween(Window.unboundedPreceding, 0)
    both = q.select(*queries.columns, value, "__q").unionByName(m.select(*queries.columns, value, "__q"))
    return both.withColumn("__v", F.last(F.when(F.col("__q") == 0, F.col(value)), ignorenulls=True).over(w)).where("__q = 1").drop("__q", value).withColumnRenamed("__v", value)


def fallback_lookup(asked: DataFrame, first: DataFrame, second: DataFrame, key: str, value: str) -> DataFrame:
    """``asked`` with ``value`` from ``first`` and, where that has none, from ``second``: the project before its SDKs."""
    a, b = first.select(key, F.col(value).alias("__a")), second.select(key, F.col(value).alias("__b"))
    return asked.join(a, key, "left").join(b, key, "left").withColumn(value, F.coalesce("__a", "__b")).drop("__a", "__b")
