"""Line dedup: overlapping windows of three lines; of equal windows all but the first lose their lines.

Lines are the parts of a text between line feeds; those without a word are passed over and stay. Windows are compared by the 128-bit
digest of their lines, stripped of white space at either end. The first occurrence is that with the least doc_id (null last), then
the least place; the lines that later windows cover, merged by place, go.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import as_bytes, durable, free_names, pieces, row_keys, semi_join

LINES = 3
SPACES = b" \t\n\x0b\x0c\r"


def line_windows(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """(k1, k2, doc_id, r1, r2, at): a row for each window of ``lines`` lines that have words."""

    def run(batches):
        import xxhash

        for batch in batches:
            for part in pieces(batch, "text"):
                digests, who, at = [], [], []
                for i, text in enumerate(as_bytes(part.column(3))):
                    full = [x for line in (text or b"").split(b"\n") if (x := line.strip(SPACES))]
                    for k in range(len(full) - lines + 1):
                        digests.append(xxhash.xxh3_128_digest(b"\n".join(full[k : k + lines])))
                        who.append(i)
                        at.append(k)
                d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                w = pa.array(who, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), *[part.column(j).take(w) for j in range(3)], pa.array(at, pa.int32())], ["k1", "k2", "doc_id", "r1", "r2", "at"])

    return docs.select("doc_id", "r1", "r2", "text").mapInArrow(run, "k1 long, k2 long, doc_id long, r1 long, r2 long, at int")


def later_windows(windows: DataFrame) -> DataFrame:
    """(r1, r2, at) of windows that are not the first of their kind; of rows that repeat, one counts as the first."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "r1", "r2", "at")
    groups = durable(windows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1"), "line-groups")
    later = semi_join(windows, groups.select("k1", "k2", "n"), ["k1", "k2"], "n").select("r1", "r2", "at")
    # all but the first of each group, which is one place; a place is first in its own group only
    return later.join(groups.select("first.r1", "first.r2", "first.at"), ["r1", "r2", "at"], "left_anti")


def dedup_lines(docs: DataFrame, lines: int = LINES, into: str = "lines") -> DataFrame:
    """``docs`` with a struct column ``into``: n_lines and n_removed, how many lines with words there are and how many go, and ``kept``, the text without those.

    A text of which no line goes is kept as it is, a null text stays null. Rows that repeat in the table (equal doc_id and text)
    count as one place, so they lose no lines to each other; rows are told apart by 128 bits of id and text. Null doc_ids come after
    all others. Texts with fewer lines than a window lose none. An empty table gives an empty one. All columns of ``docs`` stay,
    whatever their names, ``into`` apart, which is replaced.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != into.lower()])
    n1, n2, n_at = free_names(docs.columns, "r1", "r2", "at")
    r1, r2 = row_keys("doc_id", "text")
    windows = durable(line_windows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), r1, r2, "text"), lines), "line-windows")
    by_doc = later_windows(windows).groupBy(F.col("r1").alias(n1), F.col("r2").alias(n2)).agg(F.collect_set("at").alias(n_at))
    both = docs.select("*", r1.alias(n1), r2.alias(n2)).join(by_doc, [n1, n2], "left").select(*[F.col(f"`{c}`") for c in docs.columns], n_at)
    at_text, at_spans = [c.lower() for c in both.columns].index("text"), len(both.columns) - 1
    schema = both.drop(n_at).schema.add(into, StructType().add("n_lines", "long").add("n_removed", "long").add("kept", "string"))

    def run(batches):
        for batch in batches:
            for part in pieces(batch, at_text):
                texts = as_bytes(part.column(at_text))
                n_lines, n_removed, kept = [], [], []
                for text, spans in zip(texts, part.column(at_spans)):
                    all_ = (text or b"").split(b"\n")
                    full = [i for i, x in enumerate(all_) if x.strip(SPACES)]
                    gone = {full[k + j] for k in spans.values.to_pylist() for j in range(lines)} if spans.is_valid else ()
                    n_lines.append(len(full))
                    n_removed.append(len(gone))
                    kept.append(text if not gone else b"\n".join(x for i, x in enumerate(all_) if i not in gone))
                columns = [c for i, c in enumerate(part.columns) if i != at_spans]
                done = pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_lines", "n_removed", "kept"])
                yield pa.RecordBatch.from_arrays([*columns, done], [f.name for f in schema])

    return both.mapInArrow(run, schema)
