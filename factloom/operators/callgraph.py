"""Call graphs over facts: class hierarchy analysis, rapid type analysis, reachability and degrees.

Facts: class(class_id, is_abstract), extends(sub, sup), method(class_id, name), site(caller, recv, callee), alloc(caller, class_id).
A method's identity is ``class_id.name``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import durable
from .fixpoint import closure, fixpoint, opened, reachable


def method_id(class_id, name):
    return F.concat_ws(".", class_id, name)


def descendants(classes: DataFrame, extends: DataFrame) -> DataFrame:
    """(anc, des): every class with itself and all below it."""
    pairs = closure(extends.select(F.col("sup").alias("src"), F.col("sub").alias("dst")), classes.select(F.col("class_id").alias("node")))
    return pairs.select(F.col("src").alias("anc"), F.col("dst").alias("des"))


def targets(classes: DataFrame, extends: DataFrame, methods: DataFrame, sites: DataFrame) -> DataFrame:
    """(recv, callee, class_id): for what sites ask, each concrete class at or below the receiver that has a method of the name."""
    concrete = descendants(classes, extends).join(classes.where("not is_abstract").select(F.col("class_id").alias("des")), "des")
    # receivers and names are few against sites: what they ask for first, and its targets next
    asked = sites.select("recv", "callee").distinct()
    classes_asked = concrete.join(asked.select(F.col("recv").alias("anc")).distinct(), "anc", "left_semi")
    answering = methods.join(asked.select(F.col("callee").alias("name")).distinct(), "name", "left_semi")
    found = classes_asked.join(answering.select(F.col("class_id").alias("des"), F.col("name").alias("callee")), "des")
    return found.select(F.col("anc").alias("recv"), "callee", F.col("des").alias("class_id")).join(asked, ["recv", "callee"], "left_semi").distinct()


class Dispatch:
    """A call graph by groups of targets. ``sites`` are (caller, recv, callee), ``found`` what they ask for as of :func:`targets`.

    Edges are callers times targets and grow with the square of a program. Targets that the same pairs of receiver and name ask for make
    one group, each target in one; callers by groups and groups by targets grow with the program, and so do reachability and degrees over them.
    """

    def __init__(self, sites: DataFrame, found: DataFrame):
        self.sites, self.found = sites, found.withColumn("target", method_id(F.col("class_id"), F.col("callee")))

    @classmethod
    def of(cls, classes: DataFrame, extends: DataFrame, methods: DataFrame, sites: DataFrame) -> Dispatch:
        sites = durable(sites, "sites")
        return cls(sites, durable(targets(classes, extends, methods, sites), "targets"))

    def groups(self, *unit: str) -> tuple[DataFrame, DataFrame]:
        """(caller, g1, g2), and (g1, g2, unit..): callers and targets by group, which a 128-bit digest names. ``unit`` are the columns that tell targets apart."""
        sets = self.found.groupBy(*unit).agg(F.sort_array(F.collect_set(F.struct("recv", "callee"))).alias("asked"))
        sets = sets.select(*[F.xxhash64(F.lit(i), "asked").alias(f"g{i}") for i in (1, 2)], "asked", *unit)
        pairs = sets.select("g1", "g2", "asked").dropDuplicates(["g1", "g2"]).select("g1", "g2", F.explode("asked").alias("a")).select("g1", "g2", "a.*")
        return self.sites.join(pairs, ["recv", "callee"]).select("caller", "g1", "g2").distinct(), sets.drop("asked")

    def edges(self, *unit: str) -> DataFrame:
        """(caller, unit..), each once: made in the last join and not moved after it."""
        return opened(*self.groups(*unit)).select("caller", *unit)

    def out_degree(self) -> DataFrame:
        """(caller, n_targets)."""
        calls, members = self.groups("target")
        return calls.join(members.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n")), ["g1", "g2"]).groupBy("caller").agg(F.sum("n").alias("n_targets"))

    def _found(self, entries: DataFrame, allocs: DataFrame | None) -> DataFrame:
        """(kind, id, id2): methods m, classes c and groups g that the entries reach; a group is opened once, and its targets by class where ``allocs`` count."""
        calls, members = (durable(x, n) for x, n in zip(self.groups("target", "class_id"), ("calls", "members")))
        none = F.lit(None).cast("long").alias("id2")
        row = lambda kind, c: [F.lit(kind).alias("kind"), F.col(c).cast("string").alias("id"), none]
        group = [F.col("id").cast("long").alias("g1"), F.col("id2").alias("g2")]

        def step(new, known):
            kind = lambda d, k, c: d.where(F.col("kind") == k).select(F.col("id").alias(c))
            old = known.where("kind = 'g'").select(*group)
            opened = calls.join(kind(new, "m", "caller"), "caller", "left_semi").select("g1", "g2").distinct().join(old, ["g1", "g2"], "left_anti")
            out = opened.select(F.lit("g").alias("kind"), F.col("g1").cast("string").alias("id"), F.col("g2").alias("id2"))
            called = members.join(opened, ["g1", "g2"], "left_semi")
            if allocs is not None:
                out = out.unionByName(allocs.join(kind(new, "m", "caller"), "caller", "left_semi").select(*row("c", "class_id")))
                # classes that come in this round meet its groups in the next
                called = called.join(kind(known, "c", "class_id"), "class_id", "left_semi").select("target")
                called = called.unionByName(members.join(kind(new, "c", "class_id"), "class_id", "left_semi").join(old, ["g1", "g2"], "left_semi").select("target"))
            return out.unionByName(called.select(*row("m", "target")))

        return fixpoint(entries.select(*row("m", "method")), step)

    def reachable(self, entries: DataFrame) -> DataFrame:
        """(method): what the (method) entries reach, themselves included."""
        return self._found(entries, None).where("kind = 'm'").select(F.col("id").alias("method"))

    def rta(self, entries: DataFrame, allocs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Reached (method) and instantiated (class_id), as :func:`rta` finds them over edges."""
        both = self._found(entries, allocs)
        return both.where("kind = 'm'").select(F.col("id").alias("method")), both.where("kind = 'c'").select(F.col("id").alias("class_id"))

    def rta_edges(self, entries: DataFrame, allocs: DataFrame) -> DataFrame:
        """(caller, target) calls of reached methods into instantiated classes."""
        reached, made = self.rta(entries, allocs)
        sites = self.sites.join(reached.withColumnRenamed("method", "caller"), "caller", "left_semi")
        return Dispatch(sites, self.found.drop("target").join(made, "class_id", "left_semi")).edges("target")


def cha_edges(classes: DataFrame, extends: DataFrame, methods: DataFrame, sites: DataFrame) -> DataFrame:
    """(caller, target, class_id): a site calls the method of its name in each concrete class at or below the receiver's."""
    return Dispatch.of(classes, extends, methods, sites).edges("target", "class_id")


def cha_reachable(entries: DataFrame, edges: DataFrame) -> DataFrame:
    """(method): what the (method) entries reach over CHA edges, themselves included."""
    seeds = entries.select(F.col("method").alias("node"))
    return reachable(seeds, edges.select(F.col("caller").alias("src"), F.col("target").alias("dst")), []).select(F.col("node").alias("method"))


def rta(entries: DataFrame, edges: DataFrame, allocs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Reached methods and instantiated classes, which feed each other: a call needs a reached caller and an instantiated target class."""
    state = entries.select(F.lit("m").alias("kind"), F.col("method").alias("id"))

    def step(new, known):
        m = lambda d: d.where("kind = 'm'").select(F.col("id").alias("caller"))
        c = lambda d: d.where("kind = 'c'").select(F.col("id").alias("class_id"))
        made = m(new).join(allocs, "caller").select(F.lit("c").alias("kind"), F.col("class_id").alias("id"))
        by_method = m(new).join(edges, "caller").join(c(known), "class_id")
        by_class = c(new).join(edges, "class_id").join(m(known), "caller")
        called = by_method.select("target").unionByName(by_class.select("target")).select(F.lit("m").alias("kind"), F.col("target").alias("id"))
        return made.unionByName(called)

    both = fixpoint(state, step)
    return both.where("kind = 'm'").select(F.col("id").alias("method")), both.where("kind = 'c'").select(F.col("id").alias("class_id"))


def rta_edges(entries: DataFrame, edges: DataFrame, allocs: DataFrame) -> DataFrame:
    """(caller, target) calls of reached methods into instantiated classes."""
    reached, made = rta(entries, edges, allocs)
    return edges.join(reached.withColumnRenamed("method", "caller"), "caller", "left_semi").join(made, "class_id", "left_semi").select("caller", "target").distinct()


def overriding(methods: DataFrame, below: DataFrame) -> DataFrame:
    """(class_id, sub_sig, target): for each declared method every method of its sub-signature in the class itself or one below it.

    ``methods`` are (class_id, sub_sig, is_abstract), ``below`` (anc, des) as of :func:`descendants`; abstract ones are declared but are no targets.
    """
    declared = methods.select(F.col("class_id").alias("anc"), "sub_sig").distinct()
    bodies = methods.where("not is_abstract").select(F.col("class_id").alias("des"), "sub_sig").distinct()
    return declared.join(below, "anc").join(bodies, ["des", "sub_sig"]).select(F.col("anc").alias("class_id"), "sub_sig", F.col("des").alias("target"))


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("caller").agg(F.count_distinct("target").alias("n_targets"))
