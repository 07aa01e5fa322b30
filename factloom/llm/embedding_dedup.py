"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products between them, one representative a group.

Centres are fitted on a bounded sample; every vector is assigned and lives in its nearest cell. A linked pair's distances to the border
between its homes add up to its chord at most, so in each two cells only the vectors near enough to that border are multiplied, and no
link is lost, whatever the dimension. Of these products only the leading components are taken first, with the lengths of the rest as a
bound; pairs that pass are multiplied whole, and what is left is confirmed in double precision. Vectors are stored once, by cell, and
not copied: they are cut into slabs of bounded size, and in turn each slab is broadcast and all vectors stream past it. Each two cells
meet in one turn only. Equal vectors are one row with a weight. A task emits counts by vector and the groups its links make, not pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, durable
from .components import connected_components

COSINE, CELL_ROWS, MOST_CELLS, SAMPLE, BLOCK = 0.9, 1600, 4096, 20_000, 2048
#: Bytes of vectors broadcast at once, rows that a task gathers from its stream, rows and columns that are compared at once.
SLAB_BYTES, STREAM, TALL, WIDE = 32 << 20, 32_768, 4096, 8192


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """``k`` unit centres of the unit rows ``x``; the start is a seeded choice of rows."""
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = np.concatenate([(part @ c.T).argmax(1) for part in np.array_split(x, len(x) // 2048 + 1)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.sqrt((total * total).sum(1, keepdims=True))
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def leading(x: np.ndarray, cosine: float, most: float = 5e-4) -> tuple[np.ndarray, int]:
    """An orthonormal basis, the widest spread of the unit rows ``x`` first, and how many of its axes tell nearly all unlinked pairs apart."""
    basis = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    some = (x[:1000] @ basis).astype(np.float32)
    links = (some @ some.T >= cosine).mean()
    for m in range(8, x.shape[1] * 3 // 4, 8):
        z = shortened(some, m)
        if (z @ z.T >= cosine).mean() - links <= most:
            return basis, m
    return basis, x.shape[1]


def shortened(x: np.ndarray, m: int) -> np.ndarray:
    """The first ``m`` components of rows, and the length of what is left: a product of two such rows is that of the whole ones at least."""
    if m >= x.shape[1]:
        return x
    rest = x[:, m:]
    return np.concatenate([x[:, :m], np.sqrt(np.einsum("ij,ij->i", rest, rest))[:, None]], 1)


def usable(v):
    """A vector that is not null, has finite components only and is not zero."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def homes(reps: DataFrame, centres: dict[int, tuple]) -> DataFrame:
    """(home, node, weight, k1, k2, vec): the cell a vector lives in, and its components' bytes as they were given.

    ``centres`` are, by length of vectors, the number of their first cell, the cells' centres and what :func:`leading` gives; lengths that
    have none share cell -length.
    """
    given = reps.sparkSession.sparkContext.broadcast(centres)

    def run(batches):
        known = {n: (base, c.astype(np.float32)) for n, (base, c, *_) in given.value.items()}
        for batch in batches:
            lists = batch.column(4)
            length = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False)
            for n in np.unique(length):
                for at in np.array_split(idx := np.nonzero(length == n)[0], max(1, len(idx) // 1024)):
                    part = batch.take(pa.array(at))
                    raw = rows_of(part.column(4))
                    if int(n) in known:
                        base, c = known[int(n)]
                        home = (short_unit(raw) @ c.T).argmax(1) + base
                    else:
                        home = np.full(len(raw), -int(n))
                    cut = np.arange(len(raw) + 1, dtype=np.int32) * np.int32(raw.dtype.itemsize * n)
                    vec = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(raw))])
                    yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), *[part.column(i) for i in range(4)], vec], ["home", "node", "weight", "k1", "k2", "vec"])

    return reps.select("node", "weight", "k1", "k2", "embedding").mapInArrow(run, "home int, node long, weight long, k1 long, k2 long, vec binary")


def slabs(count: dict[int, int], most: int) -> list[list[tuple[int, int, int]]]:
    """Cells in slabs of about ``most`` rows at most: (cell, part, parts) each; only a cell that is larger is parted, by hash."""
    out, room = [], 0
    for cell in sorted(count):
        parts = -(-count[cell] // most)
        if parts > 1:
            out += [[(cell, i, parts)] for i in range(parts)]
            room = 0
        elif count[cell] <= room:
            out[-1].append((cell, 0, 1))
            room -= count[cell]
        else:
            out.append([(cell, 0, 1)])
            room = most - count[cell]
    return out


def in_slab(slab: list[tuple[int, int, int]]):
    whole = F.col("home").between(slab[0][0], slab[-1][0])
    _, i, parts = slab[0]
    return whole if parts == 1 else whole & (F.pmod(F.xxhash64("node"), F.lit(parts)) == i)


def bytes_of(column: pa.Array, dtype) -> np.ndarray:
    """Rows of numbers of a binary column whose values are all of one length."""
    column = column.cast(pa.binary())
    cut = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[cut[0] : cut[-1]].view(dtype).reshape(len(column), -1)


def short_unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in single precision, which finds candidates."""
    return np.concatenate([unit(part).astype(np.float32) for part in np.array_split(raw, len(raw) // 4096 + 1)])


class Slab:
    """Vectors, sorted by cell and node, against which others are compared; what their links add up to is kept until a task ends."""

    def __init__(self, home, node, weight, raw, first: int, centres, axes, cosine: float, block: int):
        self.node, self.weight, self.raw = node, weight, raw
        self.first, self.cosine, self.block = first, cosine, block
        self.basis, self.m = axes or (None, raw.shape[1])
        self.x = self.turned(self.raw)
        self.z = shortened(self.x, self.m)
        self.cells, self.cut = np.unique(home, return_index=True)
        self.cut = np.append(self.cut, len(home))
        self.slack = 1e-5 + 1e-6 * raw.shape[1]
        if centres is not None:
            self.c = (centres @ self.basis).astype(np.float32)
            self.own = np.concatenate([self.x[s:e] @ self.c[cell - first] for cell, s, e in zip(self.cells, self.cut, self.cut[1:])])
        self.start()

    def turned(self, raw: np.ndarray) -> np.ndarray:
        x = short_unit(raw)
        return x if self.basis is None else x @ self.basis.astype(np.float32)

    def start(self) -> None:
        self.linked = np.zeros(len(self.node), np.int64)
        self.up = np.arange(len(self.node))

    def top(self, at: np.ndarray) -> np.ndarray:
        """The least member known of the groups that the places ``at`` are in."""
        r = self.up[at]
        while (self.up[r] != r).any():
            r = self.up[r]
        self.up[at] = r
        return r

    def join(self, seen: dict, rows: np.ndarray, cols: np.ndarray, once: bool) -> None:
        """Links among candidates, confirmed in double precision; ``once``: a pair counts on the side of its lesser node only."""
        hit = unit(seen["raw"][rows]) @ unit(self.raw[cols]).T >= self.cosine
        a, b = seen["node"][rows][:, None], self.node[cols][None, :]
        hit &= a < b if once else a != b
        r, c = hit.any(1), hit.any(0)
        if not r.any():
            return
        hit, rows, cols = hit[np.ix_(r, c)], rows[r], cols[c]
        seen["linked"][rows] += (hit * self.weight[cols]).sum(1)
        self.linked[cols] += (hit.T * seen["weight"][rows]).sum(1)
        old, most = seen["at"][rows], len(self.node)
        linked = old >= 0
        while True:
            # least members spread over the links until none changes
            have = self.top(cols)
            least = np.where(hit, have, most).min(1)
            least[linked] = np.minimum(least[linked], was := self.top(old[linked]))
            new = np.where(hit, least[:, None], most).min(0)
            if (new == have).all() and (least[linked] == was).all() and (np.where(hit, have, -1).max(1) == least).all():
                break
            np.minimum.at(self.up, have, new)
            np.minimum.at(self.up, was, least[linked])
        seen["at"][rows] = least

    def join_pairs(self, seen: dict, rows: np.ndarray, cols: np.ndarray) -> None:
        """As :meth:`join`, for candidates given one by one."""
        hit = np.einsum("ij,ij->i", unit(seen["raw"][rows]), unit(self.raw[cols])) >= self.cosine
        rows, cols = rows[hit], cols[hit]
        np.add.at(seen["linked"], rows, self.weight[cols])
        np.add.at(self.linked, cols, seen["weight"][rows])
        who, place = np.unique(rows, return_inverse=True)
        old, most = seen["at"][who], len(self.node)
        linked = old >= 0
        while len(who):
            have, least = self.top(cols), np.full(len(who), most)
            least[linked] = was = self.top(old[linked])
            np.minimum.at(least, place, have)
            if (least[place] == have).all() and (least[linked] == was).all():
                break
            np.minimum.at(self.up, have, least[place])
            np.minimum.at(self.up, was, least[linked])
        seen["at"][who] = least if len(who) else old

    def meet(self, home: int, node: np.ndarray, weight: np.ndarray, raw: np.ndarray, x: np.ndarray):
        """(a, b, n): linked ones of these vectors of cell ``home``, sorted by node, each with one of its group here and what its links add up to."""
        seen = {"node": node, "raw": raw, "weight": weight, "linked": np.zeros(len(node), np.int64), "at": np.full(len(node), -1)}
        low = np.float32(self.cosine - self.slack)
        step = max(1, min(256, self.block))

        z, few = shortened(x, self.m), []

        def products(rows, cols, zx, zy, once=False):
            for j in range(0, len(cols), WIDE):
                p = zx @ zy[j : j + WIDE].T
                if not p.size or p.max() < low:
                    continue
                p, part = p >= low, cols[j : j + WIDE]
                if (at := np.flatnonzero(p)).size * 64 > p.size:
                    r, c = rows[p.any(1)], part[p.any(0)]
                    p = x[r] @ self.x[c].T >= low
                    if p.any():
                        self.join(seen, r[p.any(1)], c[p.any(0)], once)
                else:
                    r, c = rows[at // p.shape[1]], part[at % p.shape[1]]
                    ok = node[r] < self.node[c] if once else node[r] != self.node[c]
                    few.append((r[ok], c[ok]))

        def confirm():
            r, c = (np.concatenate([f[i] for f in few]) for i in range(2))
            few.clear()
            for i in range(0, len(r), STREAM):
                at = slice(i, i + STREAM)
                ok = np.einsum("ij,ij->i", x[r[at]], self.x[c[at]]) >= low
                if ok.any():
                    self.join_pairs(seen, r[at][ok], c[at][ok])

        # of each two cells one is met by the other, as often the lower as the higher
        odd = (self.cells + home) % 2 == 1
        turn = np.where(self.cells > home, ~odd, odd & (self.cells != home))
        if (own := np.nonzero(self.cells == home)[0]).size:
            s, e = self.cut[own[0]], self.cut[own[0] + 1]
            for i in range(0, len(node), step):
                rows = np.arange(i, min(i + step, len(node)))
                cols = np.arange(s + np.searchsorted(self.node[s:e], node[i], "right"), e)
                products(rows, cols, z[rows], self.z[e - len(cols) : e], True)
        others = np.nonzero(turn)[0] if home >= 0 else np.zeros(0, int)
        if len(others):
            c = self.c[self.cells[others] - self.first]
            mine = self.c[home - self.first]
            gap = np.ascontiguousarray(((x @ mine)[:, None] - x @ c.T).T)
            least = gap.min(1)
            far = np.sqrt(2 - 2 * self.cosine) * np.sqrt(((c - mine) ** 2).sum(1)) + self.slack
            for k in np.nonzero(least <= far)[0]:
                s, e = self.cut[others[k]], self.cut[others[k] + 1]
                gy = self.own[s:e] - self.x[s:e] @ mine
                if least[k] + (ly := gy.min()) > far[k]:
                    continue
                rows, cols = np.nonzero(gap[k] <= far[k] - ly)[0], np.nonzero(gy <= far[k] - least[k])[0]
                rows, cols = rows[np.argsort(gap[k][rows])], cols[np.argsort(gy[cols])]
                gx, gy = gap[k][rows], gy[cols]
                cols = cols + s
                zx, zy = z[rows], self.z[cols]
                part = max(1, min(step, max(32, len(rows) // 12)))
                wide = np.searchsorted(gy, far[k] - gx[::part], "right").tolist()
                for i, n in zip(range(0, len(rows), part), wide):
                    if not n:
                        break
                    products(rows[i : i + part], cols[:n], zx[i : i + part], zy[:n])
                if len(few) > 1000:
                    confirm()
        if few:
            confirm()
        got = seen["linked"] > 0
        return node[got], self.node[seen["at"][got]], seen["linked"][got]

    def end(self):
        got = np.nonzero(self.linked)[0]
        return self.node[got], self.node[self.top(got)], self.linked[got]


def compare(cells: DataFrame, slab: DataFrame, dtype, first: int, last: int, centres: np.ndarray | None, axes: tuple[np.ndarray, int] | None, cosine: float, block: int):
    """(a, b, n): each linked vector of a task with one its links reach, itself perhaps, and what its links add up to there; and the broadcast that it needs.

    ``slab`` has some rows of ``cells``; both are read by Spark, the slab into a broadcast. Cells ``first`` to ``last`` are of its length.
    """
    t = slab.select("home", "node", "weight", "vec").toArrow()
    home, node, weight = (t[c].to_numpy() for c in ("home", "node", "weight"))
    at = np.lexsort((node, home))
    # tasks hold it once: what they get is in order
    given = cells.sparkSession.sparkContext.broadcast((home[at], node[at], weight[at], bytes_of(t["vec"].combine_chunks(), dtype)[at], first, centres, axes, cosine, block))
    del t

    def run(batches):
        here = Slab(*given.value)
        names = ["a", "b", "n"]

        def turn(batch):
            home, node, weight = (batch[c].to_numpy() for c in ("home", "node", "weight"))
            raw = bytes_of(batch["vec"].combine_chunks(), dtype)
            x = here.turned(raw)
            # a cell may go on in another file, whose nodes are sorted anew
            cut = [0, *(np.nonzero((np.diff(home) != 0) | (np.diff(node) < 0))[0] + 1).tolist(), len(home)]
            for s, e in zip(cut, cut[1:]):
                for i in range(s, e, TALL):
                    at = slice(i, min(e, i + TALL))
                    a, b, n = here.meet(int(home[s]), node[at], weight[at], raw[at], x[at])
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names)

        kept, size = [], 0
        most = max(1, min(STREAM, SLAB_BYTES // here.raw[0].nbytes))
        for batch in batches:
            kept.append(batch)
            size += batch.num_rows
            if size >= most:
                yield from turn(pa.Table.from_batches(kept))
                kept, size = [], 0
        if size:
            yield from turn(pa.Table.from_batches(kept))
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in here.end()], names)

    return cells.select("home", "node", "weight", "vec").where(F.col("home").between(first, last)).mapInArrow(run, "a long, b long, n long"), given


def all_links(placed: DataFrame, dtype, centres: dict[int, tuple], cosine: float, block: int, slab_bytes: int) -> DataFrame:
    """(a, b, n) of all vectors against all, a slab after the other; what is on disk is the vectors once, by cell, and the links' sums."""
    spark = placed.sparkSession
    count = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count(F.lit(1)).alias("n")).collect()}
    files = max(2 * spark.sparkContext.defaultParallelism, -(-sum(count.values()) // 200_000))
    cells = durable(placed.select("home", "node", "weight", "vec").repartitionByRange(files, "home", F.xxhash64("node")).sortWithinPartitions("home", "node"), "cells")
    groups = [(size, base, base + len(c) - 1, c, axes) for size, (base, c, axes) in centres.items()] + [(-h, h, h, None, None) for h in count if h < 0]
    found = []
    for size, first, last, c, axes in groups:
        for slab in slabs({h: n for h, n in count.items() if first <= h <= last}, max(1, slab_bytes // (np.dtype(dtype).itemsize * size))):
            links, given = compare(cells, cells.where(in_slab(slab)), dtype, first, last, c, axes, cosine, block)
            found.append(durable(links, "links"))
            given.destroy()
    drop(cells)
    return spark.read.schema(found[0].schema).parquet(*[t._factloom_path for t in found])


def near_vectors(vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS, sample: int = SAMPLE, block: int = BLOCK, slab_bytes: int = SLAB_BYTES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of (vec_id, embedding).

    Null, zero and non-finite vectors, and those with null components, have no links and stand alone, as do vectors of a length to
    all of another length. Null vec_ids are never linked or counted. Rows that repeat count as vectors of their own for
    ``n_links``. ``sample`` vectors, those of least hash, fit the centres; ``slab_bytes`` of vectors
    are broadcast at once. An empty table gives an empty one. Other columns are not read.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = v.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    dtype = np.float32 if v.schema["embedding"].dataType.elementType.typeName() == "float" else np.float64
    given = F.col("embedding").cast("array<float>" if dtype is np.float32 else "array<double>").alias("embedding")
    keyed = good.select("vec_id", given, F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"))
    reps = durable(keyed.groupBy("k1", "k2").agg(F.min(F.struct("vec_id", "embedding")).alias("one"), F.count(F.lit(1)).alias("weight")).select("k1", "k2", F.col("one.vec_id").alias("node"), "weight", F.col("one.embedding").alias("embedding")), "vectors")
    n = reps.count()
    out = v.select("vec_id", F.xxhash64("embedding").alias("k1"), F.xxhash64(F.lit(1), "embedding").alias("k2"), usable(F.col("embedding")).alias("good"))
    if n:
        # twice as many as are wanted pass before they are sorted
        low = F.xxhash64("node") <= min((1 << 63) - 1, -(1 << 63) + (1 << 64) * (2 * sample + 1000) // n)
        few = reps.where(low).select("embedding").orderBy(F.xxhash64("node"), "node").limit(sample).toArrow()["embedding"].combine_chunks()
        lengths = pa.compute.list_value_length(few).to_numpy()
        centres, base = {}, 0
        for size in np.unique(lengths):
            # every length gets its share of the cells
            x = unit(rows_of(few.take(pa.array(np.nonzero(lengths == size)[0]))))
            cells = max(1, int(min(n // cell_rows, most_cells, len(few) // 4) * len(x) / len(few)))
            centres[int(size)] = (base, spherical_kmeans(x, cells), leading(x, cosine))
            base += cells
        placed = durable(homes(reps, centres), "homes")
        drop(reps)
        found = all_links(placed, dtype, centres, cosine, block, slab_bytes)
        comp = connected_components(found)
        counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
        reps = placed
        reps = reps.select("k1", "k2", "node", "weight").join(comp, "node", "left").join(counts, "node", "left")
    else:
        reps = reps.select("k1", "k2", "node", "weight", F.col("node").alias("component"), F.lit(0).cast("long").alias("linked"))
    known = reps.select("k1", "k2", (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n"), F.coalesce("component", "node").alias("component"))
    out = out.join(known, (out["k1"] == known["k1"]) & (out["k2"] == known["k2"]) & out["good"] & out["vec_id"].isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"))
