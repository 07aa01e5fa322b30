"""Semi-naive fixpoints, reachability and closures over relations of any size.

Rounds join only what the last round added; results of rounds are tables in the shared folder, so plans stay short.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import Cleaning, durable, fresh_dir, remove


class Known:
    """What a fixpoint has found: tables bucketed by a 128-bit digest of the row, so that no round moves what earlier ones found to tell what is new."""

    def __init__(self, like: DataFrame):
        self.spark, self.schema = like.sparkSession, like.schema
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.tables: dict[str, str] = {}
        cols = [F.col(f"`{c}`") for c in like.columns]
        # a hash passes over nulls: which columns are null counts as well
        self.digest = [F.xxhash64(F.lit(i), *cols, *[c.isNull() for c in cols]).alias(f"__h{i}") for i in (1, 2)]

    def _store(self, rows: DataFrame) -> str:
        name = f"known_{uuid.uuid4().hex}"
        self.tables[name] = path = fresh_dir(self.spark, name)
        with Cleaning(self.spark):
            rows.write.bucketBy(self.buckets, "__h1", "__h2").format("parquet").option("path", path).saveAsTable(name)
        return name

    def _rows(self, names) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*[self.tables[n] for n in names])

    def unknown(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` that are not known yet, each once, with their digests. Known tables are merged where they lie, bucket by bucket: none is sent to the driver."""
        cast = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema]
        new = rows.select(*cast).select("*", *self.digest).dropDuplicates(["__h1", "__h2"])
        for name in self.tables:
            new = new.join(self.spark.table(name).select("__h1", "__h2").hint("merge"), ["__h1", "__h2"], "left_anti")
        return new

    def add(self, rows: DataFrame) -> DataFrame:
        """Those of ``rows`` that are not known yet, each once; they are from now on."""
        return self._rows([self._store(self.unknown(rows))])

    def all(self) -> DataFrame:
        return self._rows(self.tables)

    def compact(self, most: int = 8) -> None:
        """Make one table of many, before a round joins too many."""
        if len(self.tables) > most:
            old = dict(self.tables)
            whole = self.all().select("*", *self.digest)
            self._store(whole)
            for name, path in old.items():
                self.spark.sql(f"DROP TABLE IF EXISTS {name}")
                del self.tables[name]
                remove(self.spark, path)

    def close(self) -> DataFrame:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        return self.all()


def fixpoint(seed: DataFrame, step: Callable[[DataFrame, DataFrame], DataFrame], most_rounds: int = 10_000) -> DataFrame:
    """The least relation that holds ``seed`` and ``step(new, all)`` of itself.

    ``step`` gets what the last round added and everything known, and gives rows of the same columns, which may repeat known ones.
    """
    known = Known(seed)
    new = known.add(seed)
    for _ in range(most_rounds):
        if new.isEmpty():
            return known.close()
        found = step(new, known.all()).select(*seed.columns)
        new = known.add(found)
        if len(known.tables) > 8:
            # the last delta is read again by the next round
            new = durable(new, "delta")
            known.compact()
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def reachable(seeds: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes reached from ``seeds`` (keys.., node) along ``edges`` (keys.., src, dst), the seeds included."""

    def step(new, _):
        return new.join(edges.withColumnRenamed("src", "node"), [*keys, "node"]).select(*keys, F.col("dst").alias("node"))

    return fixpoint(seeds.select(*keys, "node"), step)


def closure(edges: DataFrame, reflexive_nodes: DataFrame | None = None) -> DataFrame:
    """(src, dst) pairs joined by a path of ``edges`` (src, dst), by path doubling: rounds grow with the logarithm of the longest path."""

    def step(new, known):
        left = new.select("src", F.col("dst").alias("mid")).join(known.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        right = known.select("src", F.col("dst").alias("mid")).join(new.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst")
        return left.unionByName(right)

    out = fixpoint(edges.select("src", "dst"), step)
    if reflexive_nodes is not None:
        out = out.unionByName(reflexive_nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))).distinct()
    return out


#: Parts that the holders of a group are dealt to when it is opened.
PARTS = 8


def opened(holders: DataFrame, members: DataFrame) -> DataFrame:
    """``holders`` (.., g1, g2) with the ``members`` (g1, g2, ..) of their groups. The rows, far more than either has, are made in the last join and not moved after it."""
    spark = holders.sparkSession
    # tasks must not be made fewer by the size of what the join takes
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rest = [c for c in holders.columns if c not in ("g1", "g2")]
    left = holders.withColumn("part", F.pmod(F.xxhash64(*rest), F.lit(PARTS)).cast("int"))
    right = members.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    key = ["g1", "g2", "part"]
    return left.repartition(n, *key).join(right.repartition(n, *key), key).drop(*key)
