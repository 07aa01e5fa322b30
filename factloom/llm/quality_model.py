"""A quality classifier: random-indexing word vectors, pooled per document, and a small network with calibrated probabilities.

Every piece of a word (a run of letters, or of anything else) falls in one of ``buckets`` rows. A row's vector is the sum, over all
texts, of the sparse random index vectors of the pieces beside its pieces. A document is the mean and spread of its pieces' vectors
and its length. The network, two layers in numpy, learns from a bounded sample of labelled rows; a temperature fitted on a part of
it that training does not see calibrates its probabilities.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, durable, pieces

BUCKETS, DIM, NONZERO = 1 << 14, 32, 2
#: Labelled rows that training takes at most, those of least hash.
MOST_TRAINING = 20_000
HIDDEN, EPOCHS, CALIBRATION, SEED = 24, 40, 0.2, 5
THRESHOLD = 0.7
FEATURES = 2 * DIM + 1


def index_vectors(buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the places and signs of its index vector's nonzero components."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (buckets, NONZERO)), rng.choice([-1.0, 1.0], (buckets, NONZERO))


class Pieces(dict):
    """A word's bytes to the buckets of its pieces, remembered; forgets all at ``most`` entries."""

    def __init__(self, buckets: int, most: int = 200_000):
        super().__init__()
        import re

        import xxhash

        self.cut, self.hash, self.most = re.compile(rb"[A-Za-z\x80-\xff]+|[^A-Za-z\x80-\xff]+").findall, xxhash.xxh3_64_intdigest, most
        self.buckets = buckets

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = [self.hash(p) % self.buckets for p in self.cut(word)]
        return got

    def of(self, text: bytes | None) -> np.ndarray:
        from itertools import chain

        return np.fromiter(chain.from_iterable(map(self.__getitem__, text.split() if text else [])), np.int64)


def word_vectors(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The vector of each bucket, unit length, from all texts: a bounded table of ``buckets`` rows. Zero where nothing was seen."""
    names = [f"d{i}" for i in range(DIM)]

    def run(batches):
        place, sign = index_vectors(buckets)
        cut, total = Pieces(buckets), np.zeros(buckets * DIM)
        for batch in batches:
            for part in pieces(batch, "text"):
                texts = [cut.of(t) for t in as_bytes(part.column(0))]
                b = np.concatenate(texts)
                doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
                at = np.nonzero(doc[1:] == doc[:-1])[0]
                for one, other in ((b[at], b[at + 1]), (b[at + 1], b[at])):
                    for j in range(NONZERO):
                        total += np.bincount(one * DIM + place[other, j], sign[other, j], buckets * DIM)
        rows = total.reshape(buckets, DIM)
        some = np.nonzero(rows.any(1))[0]
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *[pa.array(rows[some, i].astype(np.int64)) for i in range(DIM)]], ["bucket", *names])

    partial = docs.select("text").mapInArrow(run, "bucket int, " + ", ".join(f"{n} long" for n in names))
    table = partial.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names]).toArrow()
    out = np.zeros((buckets, DIM))
    if table.num_rows:
        out[table["bucket"].to_numpy()] = np.stack([table[n].to_numpy() for n in names], 1)
    size = np.sqrt((out * out).sum(1, keepdims=True))
    return (out / np.where(size > 0, size, 1)).astype(np.float32)


def pooled(docs: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(doc_id, x): mean, spread and log length of each text's piece vectors as bytes; all zero for null and empty texts."""
    given = docs.sparkSession.sparkContext.broadcast(vectors)

    def run(batches):
        v = given.value
        cut = Pieces(len(v))
        for batch in batches:
            for part in pieces(batch, "text"):
                rows = np.zeros((part.num_rows, FEATURES), np.float32)
                for i, t in enumerate(as_bytes(part.column(1))):
                    b = cut.of(t)
                    if len(b):
                        # counts first, so that a long text costs no more than its distinct pieces
                        u, n = np.unique(b, return_counts=True)
                        w = (n / n.sum()).astype(np.float32)
                        mean = w @ v[u]
                        rows[i, :DIM] = mean
                        rows[i, DIM : 2 * DIM] = np.sqrt(np.maximum(w @ (v[u] * v[u]) - mean * mean, 0))
                        rows[i, -1] = np.log1p(len(b))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, x binary")


class Network:
    """Two layers, tanh and logistic, on standardised inputs; ``temperature`` divides the logit."""

    def __init__(self, n: int):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale, self.temperature = np.zeros(n), np.ones(n), 1.0
        self.p = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.p
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        """Adam on the log loss, then the temperature with the least log loss on the rows left out. Without both labels the score is their share."""
        if len(set(y.tolist())) < 2:
            self.p[2][:] = 0
            self.p[3][0] = 0.0 if not len(y) else 5.0 if y[0] else -5.0
            return self
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(x))
        cut = max(1, int(len(x) * (1 - CALIBRATION)))
        train, rest = order[:cut], order[cut:]
        self.mean, self.scale = x[train].mean(0), np.maximum(x[train].std(0), 1e-6)
        m, v, step = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(EPOCHS):
            for batch in np.array_split(rng.permutation(train), max(1, len(train) // 64)):
                w1, b1, w2, b2 = self.p
                z = (x[batch] - self.mean) / self.scale
                h = np.tanh(z @ w1 + b1)
                d = (1 / (1 + np.exp(-np.clip(h @ w2 + b2[0], -500, 500))) - y[batch]) / len(batch)
                dh = d[:, None] * w2 * (1 - h * h)
                step += 1
                for i, grad in enumerate([z.T @ dh + 1e-4 * w1, dh.sum(0), h.T @ d + 1e-4 * w2, np.array([d.sum()])]):
                    m[i] = 0.9 * m[i] + 0.1 * grad
                    v[i] = 0.999 * v[i] + 0.001 * grad * grad
                    self.p[i] = self.p[i] - 3e-3 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
        if len(rest):
            logit, yes = self.logit(x[rest]), y[rest]
            loss = lambda t: np.logaddexp(0, np.where(yes == 1, -logit, logit) / t).mean()
            self.temperature = float(min(np.exp(np.linspace(-1.5, 3, 91)), key=loss))
        return self


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float32).reshape(len(raw), FEATURES).astype(np.float64)


def held_out(doc_id):
    """Rows that training never sees: crc32 of the id's text, mod 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_TRAINING, threshold: float = THRESHOLD, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    Labels are learnt from rows that are not held out, ``most`` at most, and join documents by doc_id; null labels and ids teach
    nothing, and ids with several labels or texts teach with each. Without any label scores are 0.5. Null and empty texts are scored
    like others, by zero vectors. Null doc_ids are scored and not held out. Repeated rows get equal scores. An empty table gives an
    empty one. Only doc_id and text are read, whatever else the tables hold. ``buckets`` bounds the table of word vectors; more keep
    rare pieces of a large vocabulary apart.
    """
    x = durable(pooled(docs, word_vectors(docs, buckets)), "features")
    taught = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("y")).where(F.col("id").isNotNull() & F.col("y").isNotNull())
    # labels of documents that are here, so that others take no place in the sample
    taught = taught.where(~held_out(F.col("id"))).distinct().join(x.select(F.col("doc_id").alias("id")), "id", "left_semi")
    taught = taught.orderBy(F.xxhash64("id"), "id", "y").limit(most)
    rows = x.join(F.broadcast(taught), F.col("doc_id") == F.col("id")).select("id", "x", "y").orderBy(F.xxhash64("id"), "id", "y", "x").limit(most).toArrow()
    y = (rows["y"].to_numpy() > 0).astype(np.float64)
    network = Network(FEATURES).fit(_matrix(rows["x"].to_pylist()) if rows.num_rows else np.zeros((0, FEATURES)), y)
    given = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches):
        for batch in batches:
            s = given.value.score(_matrix(batch.column(1).to_pylist())) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = x.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
