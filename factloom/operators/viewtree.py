"""Component trees from streams of opening and closing tags: depth by a running sum, parents by the last opening one level up."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def view_tree(tags: DataFrame, atomic: list[str]) -> DataFrame:
    """(tree, pos, tag, depth, parent_pos) of the opening tags of (tree, pos, tag, is_close); ``atomic`` components close at once."""
    alone = F.col("tag").isin(atomic)
    step = F.when(alone, 0).when(F.col("is_close"), -1).otherwise(1)
    before = Window.partitionBy("tree").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    nodes = tags.withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0))).where("not is_close")
    own = nodes.select("tree", "pos", "tag", "depth", F.col("depth").alias("level"), F.lit(None).cast("int").alias("opens"), F.lit(True).alias("me"))
    under = nodes.where(~alone).select("tree", "pos", "tag", "depth", (F.col("depth") + 1).alias("level"), F.col("pos").cast("int").alias("opens"), F.lit(False).alias("me"))
    w = Window.partitionBy("tree", "level").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    both = own.unionByName(under).withColumn("parent_pos", F.last("opens", ignorenulls=True).over(w))
    return both.where("me").select("tree", "pos", "tag", F.col("depth").cast("int").alias("depth"), "parent_pos")
