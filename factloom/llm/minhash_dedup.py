"""Near-duplicate documents by MinHash: fast similarity sketches, banding, exact verification.

A sketch of t coordinates is filled in rounds. In a round every shingle is hashed to a coordinate and a value, and a coordinate
keeps the least (round, value) it gets; rounds 0..t-1 choose the coordinate by hash, rounds t..2t-1 put every shingle at coordinate
round - t, so that all are filled for certain; most sets are done after a few rounds. Rows of coordinates make band keys.

Texts with equal shingle sets form a class and its least doc_id stands for it. Representatives that share a band key are candidates:
each is compared with the least one it meets first, then with the leads of its bands that are not yet in its component, and members
outside a bucket's main component with all of that bucket, in blocks. So no pair is missed that shares a band, and a group of n
copies costs about n comparisons.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import MASK, WordHashes, as_bytes, drop, durable, free_names, mix, pieces, row_keys, whole_row
from .components import connected_components
from .substring_dedup import BASES, Words, rolling

SHINGLE, PERCENT, BANDS, ROWS = 5, 80, 48, 6
#: Rows of a block, and coordinates that are compared before sets are.
BLOCK, CHECKS = 1024, 256


def shingle_sets(texts: list[bytes | None], k: int, hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle): the distinct shingle hashes of each text, sorted by both. A text of fewer than ``k`` words has all its words as one."""
    w = Words([t.lower() if t else t for t in texts], hashes)
    ok = w.windows(k)
    g, doc = mix(rolling(w.h, k, BASES[0]))[ok] if len(ok) else np.zeros(0, np.uint64), w.doc[: len(ok)][ok]
    short = [i for i, x in enumerate(w.split) if 0 < len(x) < k]
    if short:
        one = np.fromiter((hashes.hash(b" ".join(w.split[i]), 99) for i in short), np.uint64, len(short))
        g, doc = np.concatenate([g, one]), np.concatenate([doc, np.array(short, np.int64)])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], g[new]


def sketches(doc: np.ndarray, g: np.ndarray, n_docs: int, t: int) -> np.ndarray:
    """The sketch of each set, a row of ``t`` coordinates; those of empty sets stay unfilled."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n_docs * t, empty)
    low, half = np.uint64(0xFFFFFFFF), np.uint64(32)
    for r in range(2 * t):
        if r < t or r == t:
            full = (out.reshape(n_docs, t) != empty).all(1)
            left = ~full[doc]
            doc, g = doc[left], g[left]
            if not len(doc):
                break
        x = mix(g + np.uint64((r + 1) * 0x9E3779B97F4A7C15 & MASK))
        value = (np.uint64(r) << half) | (x & low)
        at = ((x >> half) * np.uint64(t) >> half).astype(np.int64) if r < t else r - t
        np.minimum.at(out, doc * t + at, value)
    return out.reshape(n_docs, t)


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    s = mix(sketch).reshape(len(sketch), bands, rows)
    key = np.zeros(s.shape[:2], np.uint64) + np.arange(bands, dtype=np.uint64)
    for j in range(rows):
        key = mix(key * BASES[1] + s[:, :, j])
    return key


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """(doc_id, r1, r2, n, k1, k2, bands): set size, a 128-bit digest of the set, and the band keys as bytes."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch, "text"):
                doc, g = shingle_sets(as_bytes(part.column(3)), k, hashes)
                n_docs = part.num_rows
                n = np.bincount(doc, minlength=n_docs)
                digest = [np.zeros(n_docs, np.uint64) for _ in range(2)]
                for d, salt in zip(digest, BASES):
                    np.add.at(d, doc, mix(g ^ salt))
                keys = band_keys(sketches(doc, g, n_docs, bands * rows), bands, rows)
                raw = [keys[i].tobytes() if n[i] else None for i in range(n_docs)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(n.astype(np.int64)), *[pa.array(d.view(np.int64)) for d in digest], pa.array(raw, pa.binary())], ["doc_id", "r1", "r2", "n", "k1", "k2", "bands"])

    return docs.select("doc_id", "r1", "r2", "text").mapInArrow(run, "doc_id long, r1 long, r2 long, n long, k1 long, k2 long, bands binary")


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """(node, size, set): the sorted shingle hashes of each text as bytes, and how many."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch, "text"):
                doc, g = shingle_sets(as_bytes(part.column(1)), k, hashes)
                cut = np.searchsorted(doc, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(cut)), pa.array([g[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())], ["node", "size", "set"])

    return docs.select("node", "text").mapInArrow(run, "node long, size long, set binary")


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have ``percent`` of their union in common."""
    m, n = len(a), len(b)
    if not m or not n or 100 * min(m, n) < percent * max(m, n):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (m + n - common)


def verified(pairs: DataFrame, sets: DataFrame, percent: int, most_bytes: int = 4 << 20) -> DataFrame:
    """Those of the distinct (a, b) whose sets are alike; pairs whose sizes rule that out meet no set."""
    size = sets.select("node", "size").groupBy("node").agg(F.min("size").alias("least"), F.max("size").alias("most"))
    near = pairs.join(size.toDF("a", "la", "ma"), "a").join(size.toDF("b", "lb", "mb"), "b").where((100 * F.col("ma") >= percent * F.col("lb")) & (100 * F.col("mb") >= percent * F.col("la"))).select("a", "b")
    both = near.join(sets.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            for half in pieces(batch, "sa", most_bytes):
                for part in pieces(half, "sb", most_bytes):
                    sa, sb = ([np.frombuffer(x, np.uint64) for x in part.column(c).to_pylist()] for c in (2, 3))
                    ok = pa.array([alike(x, y, percent) for x, y in zip(sa, sb)], pa.bool_())
                    yield pa.RecordBatch.from_arrays([part.column(0).filter(ok), part.column(1).filter(ok)], ["a", "b"])

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def labelled(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    """``members`` with ``comp``: the component of ``node``, itself if it has no link."""
    if comp is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(comp.select("node", "component"), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")


def sketched(sets: DataFrame, t: int = CHECKS) -> DataFrame:
    """(node, size, set, sketch): with a byte of each of ``t`` coordinates of the set's sketch."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "set"):
                raw = [np.frombuffer(x, np.uint64) for x in part.column(2).to_pylist()]
                doc = np.repeat(np.arange(len(raw)), [len(x) for x in raw])
                low = (mix(sketches(doc, np.concatenate(raw), len(raw), t)) & np.uint64(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([x.tobytes() for x in low], pa.binary())], ["node", "size", "set", "sketch"])

    return sets.select("node", "size", "set").mapInArrow(run, "node long, size long, set binary, sketch binary")


def least_agreement(percent: int, t: int = CHECKS) -> int:
    """How many of ``t`` coordinates two sets of that similarity agree in, but for a chance of about one in 10^9: six standard deviations below the mean."""
    p = percent / 100
    return max(0, int(t * p - 6 * (t * p * (1 - p)) ** 0.5))


def stragglers(members: DataFrame, sets: DataFrame, percent: int, block_rows: int = BLOCK, block_bytes: int = 16 << 20) -> DataFrame:
    """Links (a, b) between members of a bucket in different components, a spanning forest of them for each block.

    ``members`` are (band, node, n, comp), n being the size of the node's set. The rest of a bucket, all that is not in its largest component, is compared with the whole
    bucket; both are cut into blocks of bounded rows and bytes and a task compares one block with one other. There sketches are
    compared first, many at once, and only pairs that agree often enough have their sets merged.
    """
    by_comp = members.groupBy("band", "comp").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("w"))
    main = by_comp.groupBy("band").agg(F.max(F.struct("c", "comp", "w")).alias("main"), F.sum("c").alias("size"), F.sum("w").alias("words"), F.count(F.lit(1)).alias("parts"))
    blocks = lambda n, words: F.greatest(F.ceil(n / block_rows), F.ceil(8 * words / block_bytes), F.lit(1)).cast("int")
    n_left, n_right = blocks(F.col("size") - F.col("main.c"), F.col("words") - F.col("main.w")), blocks(F.col("size"), F.col("words"))
    open_ = main.where("parts > 1 and size > 2").select("band", F.col("main.comp").alias("main"), n_left.alias("nl"), n_right.alias("nr"))
    spot = F.xxhash64("node")
    placed = [(F.col("comp") != F.col("main")).alias("left"), "nl", "nr", F.pmod(spot, F.col("nl")).cast("int").alias("lb"), F.pmod(spot, F.col("nr")).cast("int").alias("rb")]
    rows = members.join(open_, "band").select("band", "node", "comp", *placed)
    # buckets of other bands with the very same members are compared once
    same = rows.groupBy("band").agg(F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("sign"), F.count(F.lit(1)).alias("n"))
    rows = durable(rows.join(same.groupBy("sign", "n").agg(F.min("band").alias("band")).select("band"), "band", "left_semi"), "stragglers")
    known = durable(sketched(sets.join(rows.select("node").distinct(), "node", "left_semi")), "sketches")
    left = rows.where("left").select("band", "node", "comp", F.lit(0).alias("side"), "left", "lb", F.explode(F.sequence(F.lit(0), F.col("nr") - 1)).alias("rb"))
    right = rows.select("band", "node", "comp", F.lit(1).alias("side"), "left", F.explode(F.sequence(F.lit(0), F.col("nl") - 1)).alias("lb"), "rb")
    both = left.unionByName(right).join(known, "node")
    least = least_agreement(percent)

    def compare(table: pa.Table) -> pa.Table:
        side, rest = table["side"].to_numpy(), table["left"].to_numpy()
        node, comp, size = (table[c].to_numpy() for c in ("node", "comp", "size"))
        sets, sketch = table["set"].combine_chunks(), np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint8).reshape(len(side), -1)
        root: dict = {}

        def find(x):
            while root.get(x, x) != x:
                x = root[x]
            return x

        out = []
        right = np.nonzero(side == 1)[0]
        right = right[np.argsort(size[right], kind="stable")]
        held, ordered = sketch[right], size[right]
        for i in np.nonzero(side == 0)[0]:
            # sizes are in order: only those near enough are looked at
            a, b = np.searchsorted(ordered, [-(-percent * size[i] // 100), 100 * size[i] // percent + 1])
            near = right[a:b]
            # of two that both belong to the rest, the pair is met twice
            ok = ((held[a:b] == sketch[i]).sum(1) >= least) & (comp[near] != comp[i]) & ((node[near] > node[i]) | ~rest[near])
            for j in near[ok]:
                if (x := find(comp[i])) != (y := find(comp[j])) and alike(np.frombuffer(sets[int(i)].as_buffer(), np.uint64), np.frombuffer(sets[int(j)].as_buffer(), np.uint64), percent):
                    root[x] = y
                    out.append((node[i], node[j]))
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return both.select("band", "lb", "rb", "side", "left", "node", "comp", "size", "set", "sketch").groupBy("band", "lb", "rb").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, r1, r2, n_shingles, component_id, kept) for each row of ``docs``; ``r1`` and ``r2`` are 128 bits of id and text.

    Texts are linked when their sets of distinct ``k``-word shingles, A-Z lower-cased, share ``percent`` of the union; a component is
    the least doc_id that links reach. Null texts and texts without words have empty sets and stand alone. Rows with a null doc_id
    get a null component and are kept; rows that repeat get equal results, and texts under one doc_id belong together. An empty
    table gives an empty one. Other columns are not read. A pair of similarity s is missed with the chance (1 - s^rows)^bands, at
    0.8 less than one in a million.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys("doc_id", "text"), "text")
    sign = durable(signatures(keyed, k, bands, rows), "signatures")
    full = sign.where("n > 0 and doc_id is not null")
    classes = durable(full.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "r1", "r2", "bands")).alias("one")).select("k1", "k2", "n", "one.*"), "classes")
    reps = classes.select(F.col("doc_id").alias("node"), "n", "r1", "r2", "bands")
    at = F.sequence(F.lit(0), F.lit(bands - 1))
    banded = reps.select("node", "n", F.explode(F.transform(at, lambda i: F.xxhash64(i, F.substring(F.col("bands"), i * 8 + 1, F.lit(8))))).alias("band")).distinct()
    lead = banded.groupBy("band").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1").select("band", "lead")
    members = durable(banded.join(lead, "band"), "members")
    wanted = members.select("node").distinct()
    marked = reps.join(wanted, "node", "left_semi").select("r1", "r2")
    one = keyed.join(marked, ["r1", "r2"], "left_semi").groupBy("r1", "r2").agg(F.first("doc_id").alias("node"), F.first("text").alias("text"))
    sets = durable(sets_of(one, k), "sets")
    first = members.where("node != lead").groupBy("node").agg(F.min("lead").alias("lead"))
    links = durable(verified(first.select(F.col("node").alias("a"), F.col("lead").alias("b")), sets, percent), "links")
    comp = durable(connected_components(links), "components")
    now = labelled(members, comp).join(comp.select(F.col("node").alias("lead"), F.col("component").alias("lc")), "lead", "left")
    more = now.where(F.col("comp") != F.coalesce("lc", "lead")).select(F.col("node").alias("a"), F.col("lead").alias("b")).distinct()
    more = more.join(first.select(F.col("node").alias("a"), F.col("lead").alias("b")), ["a", "b"], "left_anti")
    old = [links, comp]
    links = durable(links.unionByName(verified(more, sets, percent)), "links")
    comp = durable(connected_components(links), "components")
    old += [links, comp]
    links = links.unionByName(stragglers(labelled(members.select("band", "node", "n"), comp), sets, percent))
    comp = durable(connected_components(links), "components")
    owner = classes.select("k1", "k2", "n", F.col("doc_id").alias("node")).join(comp, "node", "left").select("k1", "k2", "n", F.coalesce("component", "node").alias("component"))
    drop(sets, members, *old)
    out = sign.select("doc_id", "r1", "r2", "n", "k1", "k2").join(owner, ["k1", "k2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "r1", "r2", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the least doc_id's; of rows under one doc_id and text one stays, all that have a null doc_id stay.

    Null and empty texts are in no group. Which of rows stays that are equal in doc_id and text but not in other columns is fixed by a
    hash of the whole row, so reruns agree. An empty table gives an empty one. All columns stay, whatever their names.
    """
    n1, n2, nth = free_names(docs.columns, "r1", "r2", "nth")
    kept = near_duplicates(docs, k, percent).where("kept").select(F.col("r1").alias(n1), F.col("r2").alias(n2)).distinct()
    r1, r2 = row_keys("doc_id", "text")
    both = docs.select("*", r1.alias(n1), r2.alias(n2)).join(kept, [n1, n2], "left_semi")
    one = F.row_number().over(Window.partitionBy(n1, n2).orderBy(*whole_row(docs)))
    return both.withColumn(nth, one).where((F.col(nth) == 1) | F.col("doc_id").isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
