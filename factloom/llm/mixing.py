"""Mixing sources to target weights with DataFrame operations only.

The words of a source, its documents laid end to end, are cut into blocks of fixed length. Each source gets as many slots as its
target needs, of the last of them as many words as are left. Every slot falls by a keyed hash in one of the output shards that
all sources share, so the counts of the sources in a shard are drawn as multinomials while each source's total stays exact.
Slots are numbered along the shards and mapped to blocks by a keyed permutation of the source's block numbers, once around per
epoch; blocks join the documents they overlap by block number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, free_names, row_keys, whole_row
from .quality_rules import let, words_of

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 256
MOST_EPOCHS = 3
SHARD_SLOTS = 4_096
#: Prefix sums run in groups of about this many rows, and over groups in shares of so many, so that no task holds a whole source.
GROUP_ROWS, SHARE = 512, 1_024
#: Slots that a task draws, about.
TASK_SLOTS = 20_000
ROUNDS = 24


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size, source_docs, target), a row a source, from rows of (source, size).

    Sources in code-point order, null last, take ``weights`` in turn. All words are shared by weight; a target stops at ``most``
    times its source and the excess goes to the others by weight. Raised to a common level, the sources with the lowest ratio of
    cap to weight stop first, so one pass over the sources by that ratio finds the level.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    names = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(names) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = by_source.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("full_at", F.col("cap") / F.col("w"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, rest, all_ = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy(F.lit(1))
    s = s.withColumn("level", (F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest))
    # the level where the first source is left uncapped holds for all after it
    held = F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))
    s = s.withColumn("level", F.min(held).over(all_)["level"])
    return s.select("source", "source_size", "source_docs", F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("w")).alias("target"))


def permuted(k: Column, n: Column, seed: Column, back: bool = False) -> Column:
    """A keyed permutation of 0..n-1 for any n: each round swaps k with (key - k) mod n, or not, by a bit of a hash of the greater of both. A round undoes itself; ``back`` takes them in reverse."""

    def round_(acc: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(seed, r), n) - acc, n)
        return F.when(F.pmod(F.xxhash64(seed, r, F.greatest(acc, other)), F.lit(2)) == 0, acc).otherwise(other)

    ends = (ROUNDS, 1) if back else (1, ROUNDS)
    return F.aggregate(F.sequence(*map(F.lit, ends)), k, round_)


def begins(counts: DataFrame, at: str, n: str) -> DataFrame:
    """(s2, at2, begin): for each (source, ``at``) of ``counts`` the sum of ``n`` over the lesser ``at`` of its source, in shares of ``SHARE`` and of the shares before."""
    c = counts.withColumn("share", F.floor(F.col(at) / SHARE))
    sums = c.groupBy("source", "share").agg(F.sum(n).alias("all"))
    before = Window.partitionBy("source").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s2"), F.col("share").alias("share2"), F.coalesce(F.sum("all").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "share").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("inner", F.coalesce(F.sum(n).over(within), F.lit(0)))
    c = c.hint("merge").join(sums, F.col("source").eqNullSafe(F.col("s2")) & (F.col("share") == F.col("share2")))
    return c.select("s2", F.col(at).alias("at2"), (F.col("base") + F.col("inner")).alias("begin"))


def offsets(sized: DataFrame, groups: int) -> DataFrame:
    """``sized`` with ``start``: the words of the same source before the document in the order of its keyed hash."""
    d = sized.withColumn("spread", F.xxhash64(F.lit("order"), "r1", "r2"))
    d = d.withColumn("g", F.shiftrightunsigned("spread", 32) % groups)
    first = begins(d.groupBy("source", "g").agg(F.sum("size").alias("words")), "g", "words")
    within = Window.partitionBy("source", "g").orderBy("spread", "r1", "r2").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    d = d.hint("merge").join(first, F.col("source").eqNullSafe(F.col("s2")) & (F.col("g") == F.col("at2")))
    return d.withColumn("start", F.col("begin") + F.col("inner")).drop("s2", "at2", "begin", "inner", "spread", "g")


def drawn_blocks(targets: DataFrame, block: int, seed: int, shard_slots: int = SHARD_SLOTS, chunk: int = 1_000) -> DataFrame:
    """(source, block, lo, hi, times, shards): how often the mix takes the words lo to hi of each block that it takes, and the output shard of each time.

    Blocks are taken whole but for a source's last slot, which ends where its target, rounded to words, is met.
    """
    whole = F.floor(F.try_divide("target", "source_size"))
    t = targets.where("source_size > 0").withColumn("seed", F.xxhash64(F.lit(seed), "source", F.col("source").isNull())).withColumn("whole", whole)
    t = t.withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    # what the last block lacks, and the slot of an epoch that takes it
    t = t.withColumn("lack", F.col("n_blocks") * block - F.col("source_size")).withColumn("lacks_at", permuted(F.col("n_blocks") - 1, F.col("n_blocks"), F.col("seed"), back=True))
    need = F.ceil(F.col("rest") / block)
    t = t.withColumn("more", F.when(need <= F.col("lacks_at"), need).otherwise(F.ceil((F.col("rest") + F.col("lack")) / block)))
    before = (F.col("more") - 1) * block - F.when(F.col("lacks_at") < F.col("more") - 1, F.col("lack")).otherwise(0)
    t = t.withColumn("cut", F.when(F.col("more") > 0, F.col("rest") - before).otherwise(block)).withColumn("slots", F.col("whole") * F.col("n_blocks") + F.col("more"))
    t = t.where("slots > 0").select("source", "n_blocks", "slots", "cut", F.sum("slots").over(Window.partitionBy(F.lit(1))).alias("all_slots"), "seed")
    # ranges of slots first, so that a large source is spread before its slots become rows
    tasks = max(1, (targets.agg(F.sum(F.ceil(F.col("target") / block))).first()[0] or 0) // TASK_SLOTS)
    ranges = t.withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / chunk)))).repartition(tasks, "source", "c")
    slots = ranges.withColumn("slot", F.explode(F.sequence(F.col("c") * chunk, F.least((F.col("c") + 1) * chunk, F.col("slots")) - 1)))
    shards = F.greatest(F.lit(1).cast("long"), F.floor(F.col("all_slots") / shard_slots))
    slots = slots.withColumn("shard", F.pmod(F.xxhash64("seed", F.lit("shard"), "slot"), shards))
    # the multinomial counts of a source by shard, and where each begins along the shards
    counts = slots.groupBy("source", "shard").agg(F.count(F.lit(1)).alias("n"))
    first = begins(counts, "shard", "n")
    place = Window.partitionBy("source", "shard").orderBy("slot")
    slots = slots.withColumn("i", F.row_number().over(place) - 1)
    # merge joins: a plan's guess of how many rows a range makes would broadcast what grows with the input
    slots = slots.hint("merge").join(first, F.col("source").eqNullSafe(F.col("s2")) & (F.col("shard") == F.col("at2")))
    place = F.col("begin") + F.col("i")
    words = F.when(place == F.col("slots") - 1, F.col("cut")).otherwise(block).cast("long")
    took = slots.select("source", F.struct(words.alias("words"), "shard").alias("time"), permuted(place % F.col("n_blocks"), F.col("n_blocks"), F.col("seed")).alias("block"))
    took = took.groupBy("source", "block").agg(F.sort_array(F.collect_list("time")).alias("all")).withColumn("cut", F.col("all")[0]["words"])
    full = F.filter("all", lambda x: x["words"] == block)
    part = lambda lo, hi, x: F.struct(lo.alias("lo"), hi.alias("hi"), F.size(x).cast("long").alias("times"), F.sort_array(F.transform(x, lambda y: y["shard"])).alias("shards"))
    end = F.lit(block).cast("long")
    parts = F.filter(F.array(part(F.lit(0).cast("long"), F.col("cut"), F.col("all")), part(F.col("cut"), end, full)), lambda x: (x["lo"] < x["hi"]) & (x["times"] > 0))
    return took.select("source", "block", F.explode(parts).alias("p")).select("source", "block", "p.*")


def mix_documents(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK_WORDS, seed: int = 7, shard_slots: int = SHARD_SLOTS) -> DataFrame:
    """Rows of (doc_id, r1, r2, size, source_size, target, taken, parts), one a document.

    ``parts`` are structs (from, to, times, shards): ranges of the document's words in order, how often the mix takes them and
    the output shard of each time, of about ``shard_slots`` blocks of all sources together; ``taken`` is the sum of their words
    times that. ``r1`` and ``r2`` are 128 bits of doc_id, text and source. Blocks have ``block`` words in every source, but for its last one and
    the last one taken, so that a source's ``taken`` adds up to its target, rounded. Null doc_ids and sources are values like
    any other; null and empty texts have size 0 and no parts; rows repeated in the table are documents of their own, each with
    its own range of words. No document is taken more than three times over. An empty table gives an empty one. Other columns
    are not read. Reruns agree.
    """
    sized = docs.select("doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), *row_keys("doc_id", "text", "source"))
    sized = durable(sized, "sizes")
    targets = source_targets(sized, weights)
    targets = targets.withColumn("n_blocks", F.ceil(F.col("source_size") / block))
    t = targets.select(F.col("source").alias("s3"), "source_size", "target")
    placed = offsets(sized, max(1, sized.count() // GROUP_ROWS)).join(t, F.col("source").eqNullSafe(F.col("s3"))).drop("s3")
    start, end = F.col("start"), F.col("start") + F.col("size")
    over = placed.where("size > 0").withColumn("b", F.explode(F.sequence(F.floor(start / block), F.floor((end - 1) / block))))
    drawn = drawn_blocks(targets, block, seed, shard_slots).select(F.col("source").alias("s4"), "block", "lo", "hi", "times", "shards")
    over = over.hint("merge").join(drawn, F.col("source").eqNullSafe(F.col("s4")) & (F.col("b") == F.col("block")), "left")
    part = F.struct((F.greatest(F.col("b") * block + F.col("lo"), start) - start).alias("from"), (F.least(F.col("b") * block + F.col("hi"), end) - start).alias("to"))
    over = over.withColumn("part", part).withColumn("held", F.col("part.from") < F.col("part.to"))
    full = F.struct("part.from", "part.to", "times", "shards")
    got = over.groupBy("doc_id", "r1", "r2", "source", "start", "size", "source_size", "target").agg(
        F.coalesce(F.sum(F.when(F.col("held"), F.col("times") * (F.col("part.to") - F.col("part.from")))), F.lit(0)).alias("taken"),
        F.sort_array(F.collect_list(F.when(F.col("times").isNotNull() & F.col("held"), full))).alias("parts"),
    )
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long")).withColumn("parts", F.array().cast(got.schema["parts"].dataType))
    names = ["doc_id", "r1", "r2", "size", "source_size", "target", "taken", "parts"]
    return got.select(*names).unionByName(none.select(*names))


def mixed_texts(docs: DataFrame, weights=WEIGHTS, block: int = BLOCK_WORDS, seed: int = 7) -> DataFrame:
    """The mix as documents: for each document and each time it is taken, a row with its columns, ``text`` cut to the words taken then.

    A text of which every word is taken stays as it is; of others the words taken are joined by single spaces. Documents of which
    nothing is taken go, so null and empty texts do. Null doc_ids and sources are values like any other. Rows that are equal in doc_id,
    text and source are taken each for itself; which of them gets which part is fixed by a hash of the whole row, so reruns agree.
    ``n_chars``, where present, is the length of the new text. An empty table gives an empty one. All columns stay, whatever their names.
    """
    d1, d2, nd, p1, p2, np_, size, parts, times = free_names(docs.columns, "d1", "d2", "nd", "p1", "p2", "np", "size", "parts", "times")
    plan = mix_documents(docs, weights, block, seed).where("taken > 0").select(F.col("r1").alias(p1), F.col("r2").alias(p2), F.col("size").alias(size), F.col("parts").alias(parts))
    # rows that repeat are told apart by a running number on either side
    plan = plan.withColumn(np_, F.row_number().over(Window.partitionBy(p1, p2).orderBy(parts)))
    r1, r2 = row_keys("doc_id", "text", "source")
    keyed = docs.select("*", r1.alias(d1), r2.alias(d2))
    keyed = keyed.withColumn(nd, F.row_number().over(Window.partitionBy(d1, d2).orderBy(*whole_row(docs))))
    both = keyed.join(plan, (F.col(d1) == F.col(p1)) & (F.col(d2) == F.col(p2)) & (F.col(nd) == F.col(np_)))
    both = both.withColumn(times, F.explode(F.sequence(F.lit(1), F.array_max(F.transform(parts, lambda p: p["times"])).cast("int"))))
    now = F.filter(parts, lambda p: p["times"] >= F.col(times))
    covered = F.aggregate(now, F.lit(0).cast("long"), lambda a, p: a + p["to"] - p["from"])
    cut = let(words_of(F.col("text")), lambda w: F.array_join(F.flatten(F.transform(now, lambda p: F.slice(w, (p["from"] + 1).cast("int"), (p["to"] - p["from"]).cast("int")))), " "))
    text = F.when(covered == F.col(size), F.col("text")).otherwise(cut)
    names = {c.lower(): c for c in docs.columns}
    both = both.withColumn(names["text"], text)
    if "n_chars" in names:
        both = both.withColumn(names["n_chars"], F.length("text").cast(docs.schema[names["n_chars"]].dataType))
    return both.select(*[F.col(f"`{c}`") for c in docs.columns])
