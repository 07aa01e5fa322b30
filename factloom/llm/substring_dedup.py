"""Substring dedup: windows of words that occur more than once, through a log-structured fingerprint index.

Of every window of ``width`` words the least hash among its ``gram``-word grams is a fingerprint; equal windows have equal ones, and
neighbours mostly share theirs, so few are stored. Fingerprints of a batch are merge-joined with the sorted immutable runs of the
batches before it, runs of a level are merged when there are enough, and what occurs twice is a candidate. Candidates are verified:
stretches of windows with one fingerprint, then single windows where stretches differ, are compared by 128-bit digests of all their words.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import Cleaning, remove, write_text
from .common import MASK, WordHashes, as_bytes, drop, durable, fresh_dir, mix, pieces, row_keys, semi_join

WIDTH, GRAM, BATCHES, FANOUT = 35, 8, 3, 2
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))


def rolling(h: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """Polynomial hashes of the ``k`` values from each place on, by doubling."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    out, done, cur, size, power = None, 0, h, 1, base
    while True:
        if k & size:
            if out is None:
                out, done = cur, size
            else:
                m = n - done - size + 1
                out, done = out[:m] * power + cur[done : done + m], done + size
        if 2 * size > k:
            return out[: n - k + 1]
        m = n - 2 * size + 1
        cur, size = cur[:m] * power + cur[size : size + m], 2 * size
        power = np.uint64(int(power) ** 2 & MASK)


def sliding(a: np.ndarray, k: int, op) -> np.ndarray:
    """``op`` (minimum or maximum) over the ``k`` values from each place on."""
    n, size = len(a), 1
    if n < k:
        return a[:0]
    while 2 * size <= k:
        a, size = op(a[: len(a) - size], a[size:]), 2 * size
    m = n - k + 1
    return op(a[:m], a[k - size : k - size + m])


class Words:
    """The words of some texts as one array of hashes, with the limits of each text."""

    def __init__(self, texts: list[bytes | None], hashes: WordHashes):
        self.split = [t.split() if t else [] for t in texts]
        self.size = np.fromiter(map(len, self.split), np.int64, len(texts))
        self.end = np.cumsum(self.size)
        self.begin = self.end - self.size
        self.h = np.concatenate([hashes.of(w) for w in self.split]) if len(texts) else np.zeros(0, np.uint64)
        self.doc = np.repeat(np.arange(len(texts)), self.size)

    def windows(self, width: int) -> np.ndarray:
        """For each place whether a window of one text starts there."""
        n = max(0, len(self.h) - width + 1)
        return self.end[self.doc[:n]] - np.arange(n) >= width


def fingerprints(words: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of each gram, each window's least one, and whether the window is one of a text."""
    g = mix(rolling(words.h, gram, BASES[0]))
    low = sliding(g, width - gram + 1, np.minimum)
    return g, low, words.windows(width)


def sampled(words: Words, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprint, text) of every gram that is the least of some window."""
    g, low, ok = fingerprints(words, width, gram)
    if not ok.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    span = width - gram
    edge = np.zeros(span, np.uint64)
    high = sliding(np.concatenate([edge, np.where(ok, low, np.uint64(0)), edge]), span + 1, np.maximum)
    at = np.nonzero(high == g)[0]
    return g[at], words.doc[at]


def postings(docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """(fp, r1, r2, n): the fingerprints of each text and how often each occurs in it."""

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            for part in pieces(batch, "text"):
                fp, doc = sampled(Words(as_bytes(part.column(2)), hashes), width, gram)
                order = np.lexsort((fp, doc))
                fp, doc = fp[order], doc[order]
                new = np.ones(len(fp), bool)
                new[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])
                at = np.nonzero(new)[0]
                n = np.diff(np.append(at, len(fp)))
                who = pa.array(doc[at])
                yield pa.RecordBatch.from_arrays([pa.array(fp[at].view(np.int64)), part.column(0).take(who), part.column(1).take(who), pa.array(n, pa.int32())], ["fp", "r1", "r2", "n"])

    return docs.select("r1", "r2", "text").mapInArrow(run, "fp long, r1 long, r2 long, n int")


class FingerprintIndex:
    """A log-structured index of fingerprints in a folder of the shared file system: sorted immutable runs of (fp, n), named in a manifest.

    Runs are bucketed and sorted by fp, all in ``buckets`` buckets, so joins and merges of runs move no row. ``add`` stores a batch as a
    run and joins it with those before; ``compact`` makes ``fanout`` runs of a level one of the next. ``open`` takes up an index that
    another session left; a run that is in the folder but not in the manifest was never finished and is not read.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int, fanout: int, runs: list, hits: list):
        self.spark, self.path, self.buckets, self.fanout, self.runs, self.hit_names = spark, path, buckets, fanout, runs, hits

    @classmethod
    def create(cls, spark: SparkSession, path: str | None = None, buckets: int | None = None, fanout: int = FANOUT) -> FingerprintIndex:
        """An empty index; ``buckets`` is how many shares a run has for good, by default the session's shuffle partitions."""
        index = cls(spark, path or fresh_dir(spark, "index"), buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), fanout, [], [])
        index._save()
        return index

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        kept = json.loads(spark.read.option("wholetext", True).text(f"{path}/manifest.json").first()[0])
        return cls(spark, path, kept["buckets"], kept["fanout"], [tuple(r) for r in kept["runs"]], kept["hits"])

    def _save(self) -> None:
        write_text(self.spark, f"{self.path}/manifest.json", json.dumps({"buckets": self.buckets, "fanout": self.fanout, "runs": self.runs, "hits": self.hit_names}))

    def _store(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        with Cleaning(self.spark):
            rows.write.bucketBy(self.buckets, "fp").sortBy("fp").format("parquet").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def _run(self, name: str) -> DataFrame:
        if not self.spark.catalog.tableExists(name):
            place = f"{self.path}/{name}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} (fp BIGINT, n BIGINT) USING parquet CLUSTERED BY (fp) SORTED BY (fp) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return self.spark.table(name).hint("merge")

    def add(self, batch: DataFrame) -> DataFrame:
        """Store a batch of (fp, n); give (fp, n) of those that occur again in it or in the index, n being how often with those before."""
        rows = batch.groupBy("fp").agg(F.sum("n").alias("n"))
        if int(self.spark.conf.get("spark.sql.shuffle.partitions")) != self.buckets:
            rows = rows.repartition(self.buckets, "fp")
        name = self._store(rows)
        again = self._run(name)
        total = F.col("n")
        for i, (_, old) in enumerate(self.runs):
            again = again.join(self._run(old).withColumnRenamed("n", f"n{i}"), "fp", "left")
            total = total + F.coalesce(F.col(f"n{i}"), F.lit(0))
        kept = f"hits-{uuid.uuid4().hex}"
        with Cleaning(self.spark), self._sorted():
            again.select("fp", total.alias("n")).where("n > 1").write.parquet(f"{self.path}/{kept}")
        self.runs.append((0, name))
        self.hit_names.append(kept)
        self._save()
        return self._read_hits([kept])

    @contextmanager
    def _sorted(self):
        """Files of a bucket are read in their order while a plan over runs is made."""
        key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
        before = self.spark.conf.get(key, "false")
        self.spark.conf.set(key, "true")
        try:
            yield
        finally:
            self.spark.conf.set(key, before)

    def _read_hits(self, names: list[str]) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], "fp long, n long")
        return self.spark.read.schema("fp long, n long").parquet(*[f"{self.path}/{x}" for x in names])

    def hits(self) -> DataFrame:
        """(fp, n): every fingerprint that occurs twice or more in all that was added, and how often at least."""
        return self._read_hits(self.hit_names).groupBy("fp").agg(F.max("n").alias("n"))

    def compact(self) -> None:
        """While a level has ``fanout`` runs, merge them, two by two, into one of the next."""
        level = 0
        while len(same := [r for k, r in self.runs if k == level]) >= self.fanout:
            old, gone = list(same), []
            while len(same) > 1:
                a, b, *rest = same
                both = self._run(a).join(self._run(b).withColumnRenamed("n", "m"), "fp", "full").select("fp", (F.coalesce("n", F.lit(0)) + F.coalesce("m", F.lit(0))).alias("n"))
                with self._sorted():
                    same = [*rest, self._store(both)]
                gone += [a, b]
            self.runs = [(k, r) for k, r in self.runs if r not in old] + [(level + 1, same[0])]
            self._save()
            for name in gone:
                self._forget(name)
                remove(self.spark, f"{self.path}/{name}")
            level += 1

    def _forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def close(self) -> None:
        """Take the runs out of the session's catalog; the folder stays."""
        for _, name in self.runs:
            self._forget(name)

    def delete(self) -> None:
        self.close()
        remove(self.spark, self.path)


def stretches(docs: DataFrame, width: int, gram: int) -> DataFrame:
    """Candidate windows of each text of (r1, r2, text, hits), those with one fingerprint in a row as one stretch.

    (k1, k2, r1, r2, first, windows): the digest of the stretch's words, its first window and the 16-byte digests of its windows.
    """

    def run(batches):
        hashes, second = WordHashes(), WordHashes(1)
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                texts = as_bytes(part.column(2))
                words = Words(texts, hashes)
                g, low, ok = fingerprints(words, width, gram)
                if not ok.any():
                    continue
                hits = part.column(3)
                found = np.zeros(len(low), bool)
                for i in range(part.num_rows):
                    a, b = words.begin[i], words.end[i] - width + 1
                    if b > a:
                        found[a:b] = np.isin(low[a:b], hits[i].values.to_numpy().view(np.uint64))
                at = np.nonzero(found & ok)[0]
                if not len(at):
                    continue
                h2 = np.concatenate([second.of(w) for w in words.split])
                w1, w2 = mix(rolling(words.h, width, BASES[0])), mix(rolling(h2, width, BASES[1]))
                new = np.ones(len(at), bool)
                new[1:] = (at[1:] != at[:-1] + 1) | (low[at[1:]] != low[at[:-1]]) | (words.doc[at[1:]] != words.doc[at[:-1]])
                first = np.nonzero(new)[0]
                n = np.diff(np.append(first, len(at)))
                packed = np.stack([w1[at], w2[at]], 1)
                # the windows of a stretch, one after the other, stand for all its words
                step = np.arange(len(at)) - np.repeat(first, n)
                weight = mix(step.astype(np.uint64) + np.uint64(1)) | np.uint64(1)
                k1, k2 = (mix(np.add.reduceat(packed[:, j] * weight, first) + n.astype(np.uint64)) for j in (0, 1))
                who = pa.array(words.doc[at[first]])
                offsets = np.append(first, len(at)) * 16
                raw = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(packed.tobytes())])
                start = at[first] - words.begin[words.doc[at[first]]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), part.column(0).take(who), part.column(1).take(who), pa.array(start, pa.int32()), raw], ["k1", "k2", "r1", "r2", "first", "windows"]
                )

    return docs.select("r1", "r2", "text", "hits").mapInArrow(run, "k1 long, k2 long, r1 long, r2 long, first int, windows binary")


def unpacked(rows: DataFrame) -> DataFrame:
    """(w1, w2, r1, r2, at, many): a row for each window of the stretches."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "windows"):
                raw = part.column(4).to_pylist()
                n = np.fromiter((len(x) // 16 for x in raw), np.int64, len(raw))
                w = np.frombuffer(b"".join(raw), np.int64).reshape(-1, 2)
                who = pa.array(np.repeat(np.arange(len(raw)), n))
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                first = part.column(2).take(who).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(w[:, 0].copy()), pa.array(w[:, 1].copy()), part.column(0).take(who), part.column(1).take(who), pa.array((first + at).astype(np.int32)), part.column(3).take(who)], ["w1", "w2", "r1", "r2", "at", "many"])

    return rows.select("r1", "r2", "first", "many", "windows").mapInArrow(run, "w1 long, w2 long, r1 long, r2 long, at int, many boolean")


def repeated_spans(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """(r1, r2, first, last): windows of (r1, r2, text), by the number of their first word, whose word sequence starts elsewhere too.

    Without an ``index`` the texts go through one of their own in ``batches``. With one, to which :func:`add_texts` has added all of
    them in batches of any size and session, candidates are those that it holds.
    """
    posts = durable(postings(docs, width, gram), "postings")
    own = index is None
    if own:
        index = FingerprintIndex.create(docs.sparkSession)
        for k in range(batches):
            if k:
                index.compact()
            index.add(posts.where(F.pmod(F.col("r1"), F.lit(batches)) == k).select("fp", "n"))
    hits = durable(index.hits(), "hits")
    by_doc = durable(semi_join(posts, hits, ["fp"], "n").groupBy("r1", "r2").agg(F.collect_set("fp").alias("hits")), "candidates")
    drop(posts, hits)
    if own:
        index.delete()
    found = durable(stretches(docs.select("r1", "r2", "text").join(by_doc, ["r1", "r2"]), width, gram), "stretches")
    drop(by_doc)
    groups = durable(found.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("r1", "r2", "first", "windows")).alias("one")), "groups")
    same = semi_join(found.select("k1", "k2", "r1", "r2", "first", (F.octet_length("windows") / 16).cast("int").alias("len")), groups.where("n > 1").select("k1", "k2", "n"), ["k1", "k2"], "n")
    spans = same.select("r1", "r2", "first", (F.col("first") + F.col("len") - 1).alias("last"))
    windows = unpacked(groups.select("one.*", (F.col("n") > 1).alias("many")))
    twice = windows.groupBy("w1", "w2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = durable(twice, "repeated")
    single = semi_join(windows.where("not many"), repeated, ["w1", "w2"], "n").select("r1", "r2", F.col("at").alias("first"), F.col("at").alias("last"))
    out = durable(spans.unionByName(single), "spans")
    drop(found, groups, repeated)
    return out


def add_texts(index: FingerprintIndex, docs: DataFrame, width: int = WIDTH, gram: int = GRAM) -> DataFrame:
    """Add the texts of ``docs`` to the index as a batch; (fp, n) of the fingerprints that it meets again."""
    return index.add(postings(docs.select(*row_keys("doc_id", "text"), "text"), width, gram).select("fp", "n"))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) for each row of ``docs``: what is left without words covered by a repeated window.

    Null and empty texts have no words; texts shorter than a window lose none. Windows of all rows count, those of repeated rows and
    of one text included. Null doc_ids are an id like any other; rows are told apart by 128 bits of id and text. An empty table gives
    an empty one. Other columns, whatever their names, are not read. ``index`` is as in :func:`repeated_spans`.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys("doc_id", "text"), "text")
    spans = repeated_spans(keyed, width, gram, batches, index)
    by_doc = durable(spans.groupBy("r1", "r2").agg(F.collect_set(F.struct("first", "last")).alias("spans")), "removals")
    drop(spans)
    both = keyed.join(by_doc, ["r1", "r2"], "left").select("doc_id", "text", "spans")

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                out = [[], [], [], []]
                for text, spans in zip(as_bytes(part.column(1)), part.column(2)):
                    words = text.split() if text else []
                    n = len(words)
                    if spans.is_valid:
                        edge = np.zeros(n + 1, np.int64)
                        s = spans.values.flatten()
                        np.add.at(edge, s[0].to_numpy(), 1)
                        np.add.at(edge, s[1].to_numpy() + width, -1)
                        words = [words[i] for i in np.nonzero(np.cumsum(edge[:n]) == 0)[0]]
                    kept = b" ".join(words)
                    for col, v in zip(out, (n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace"))):
                        col.append(v)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string()))]], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
