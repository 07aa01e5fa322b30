"""What the corpus operators share: word rules, shared-folder tables, row keys and Arrow plumbing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..tables import drop, durable, fresh_dir  # noqa: F401

#: A word: a maximal run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
MASK = (1 << 64) - 1


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.expr("0L") + F.regexp_count(text, F.lit(WORD)), F.lit(0).cast("long"))


def row_keys(*columns: str) -> list[Column]:
    """``r1`` and ``r2``, 128 bits over the columns: what tells rows apart where ids are null or repeat."""
    return _digests([F.col(c) for c in columns])


def _digests(columns: list[Column]) -> list[Column]:
    # a hash passes over nulls: which columns are null counts as well
    return [F.xxhash64(F.lit(i), *columns, *[c.isNull() for c in columns]).alias(f"r{i + 1}") for i in range(2)]


def free_names(taken: list[str], *wanted: str) -> list[str]:
    """``wanted``, each lengthened until it differs from all of ``taken``, in any case: names for helper columns beside a user's."""
    have, out = {c.lower() for c in taken}, []
    for w in wanted:
        while w.lower() in have:
            w += "_"
        have.add(w.lower())
        out.append(w)
    return out


def whole_row(df: DataFrame) -> list[Column]:
    """128 bits over all columns that can be hashed: an order of rows that only equal ones tie in."""
    return _digests([F.col(f"`{f.name}`") for f in df.schema if not has_map(f.dataType)])


def has_map(kind) -> bool:
    """Whether a type is, or holds, one that Spark cannot hash."""
    from pyspark.sql import types as t

    if isinstance(kind, t.ArrayType):
        return has_map(kind.elementType)
    if isinstance(kind, t.StructType):
        return any(has_map(f.dataType) for f in kind)
    return isinstance(kind, (t.MapType, t.VariantType))


def semi_join(left: DataFrame, right: DataFrame, keys: list[str], n: str, share: int = 1000) -> DataFrame:
    """Rows of ``left`` with keys among the distinct ones of ``right``, a stored table whose ``n`` tells how many such rows there are, at least about.

    Keys of more than one row in ``share`` are ``share`` at most: these are broadcast, and their rows are dealt out by their other
    columns instead of meeting in one task. ``left`` is made once.
    """
    hot = F.col(n) > max(1000, (right.agg(F.sum(n)).first()[0] or 0) // share)
    known = right.where(hot).select(*keys, F.lit(True).alias("__hot"))
    cold = right.where(~hot).select(*keys, F.lit(0).alias("__salt"), F.lit(True).alias("__cold"))
    others = [c for c in left.columns if c not in keys]
    salt = F.when(F.col("__hot"), (F.pmod(F.xxhash64(*others), F.lit(share)) + 1).cast("int")).otherwise(0)
    marked = left.join(F.broadcast(known), keys, "left").withColumn("__salt", salt)
    return marked.join(cold, [*keys, "__salt"], "left").where("__hot or __cold").select(*left.columns)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str, state: Callable[[], object] | None = None) -> DataFrame:
    """``mapInArrow`` with a function of one batch; ``state`` is made once a task and passed as second argument."""

    def run(batches):
        kept = state() if state else None
        for batch in batches:
            if batch.num_rows:
                yield from (fn(batch, kept) if state else fn(batch))

    return df.mapInArrow(run, schema)


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices whose ``column`` holds about ``most_bytes`` at most, one row at least; nothing is left out."""
    size = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).cumsum()
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + most_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHashes(dict):
    """Bytes to their 64-bit hash, remembered; forgets all at ``most`` entries."""

    def __init__(self, seed: int = 0, most: int = 250_000):
        super().__init__()
        import xxhash

        self.seed, self.most, self.hash = seed, most, xxhash.xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.hash(word, self.seed)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
