"""Token counts: pieces once per distinct pre-token, joined to per-document pre-token frequencies.

A pre-token is a piece of text that the tokenizer never joins with its surroundings. A first pass counts the rows each pre-token
makes; distinct ones are tokenized once and stored with their number of pieces. The most frequent ``hot`` of them, a bounded table,
are joined inside the second pass over the texts; frequencies of all others are shuffled to the stored table and summed by document.
"""

from __future__ import annotations

import json
from collections import Counter
from itertools import chain, repeat
from operator import mul

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, map_arrow, row_keys

HOT = 131_072


def split_rules(path: str) -> tuple[str, list[str]] | None:
    """The pattern that the tokenizer in ``path`` finds pieces by between white space, and its special strings; None where its texts cannot be cut like that.

    They can where the normaliser does nothing but compose, make white space spaces and lower-case, the split keeps what the pattern
    finds and drops the rest, and what follows is byte-level without a pattern of its own.
    """
    with open(path, encoding="utf-8") as f:
        kept = json.load(f)
    normal, pre = kept.get("normalizer") or {}, kept.get("pre_tokenizer") or {}
    steps = normal.get("normalizers", [normal])
    plain = [s.get("type") for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1].get("pattern") == {"Regex": r"\s+"} and steps[1].get("content") == " "
    parts = pre.get("pretokenizers", [pre])
    if not plain or [p.get("type") for p in parts] != ["Split", "ByteLevel"] or (kept["model"].get("dropout") or 0) > 0:
        return None
    split, level = parts
    pattern = split.get("pattern", {}).get("Regex")
    if pattern is None or not (split.get("behavior") == "Removed" and split.get("invert")) or level.get("use_regex", True) or level.get("add_prefix_space", True):
        return None
    return pattern, [t["content"] for t in kept.get("added_tokens", [])]


class PreTokens:
    """Cuts texts into pre-tokens, exactly or not at all; without ``rules`` a text is one pre-token.

    Units between white space are cut by the pattern only if they are lower-cased Latin-1 text without special strings, where
    normal forms and letter classes are plain; any other unit is a pre-token itself, and a text with control characters that
    Python, but not the tokenizer, takes for white space is one as a whole.
    """

    def __init__(self, rules: tuple[str, list[str]] | None):
        import re

        import regex

        pattern, special = rules or ("", [])
        self.whole = rules is None or any(re.search(r"\s", s) for s in special)
        odd = "[\x1c-\x1f]"
        self.cut, self.odd = regex.compile(pattern).findall, re.compile(odd).search
        # a unit may hold a special string, or a part of one that lower-casing or composing would complete
        self.uncut = re.compile("|".join([odd, *(re.escape(s[:2]) for s in special)])).search

    def units(self, text: str) -> list[str]:
        return [text] if self.whole or self.odd(text) else text.split()

    def of_unit(self, unit: str) -> list[str]:
        if self.whole or self.uncut(unit) or (not unit.isascii() and max(unit) > "ÿ"):
            return [unit]
        return self.cut(unit.lower())


class KnownPieces(dict):
    """Units map to the tokens of those of their pre-tokens that ``known`` has; ``rare`` holds the others of units that have any."""

    def __init__(self, cut: PreTokens, known: dict[str, int], most: int = 8 << 20):
        super().__init__()
        self.cut, self.known, self.most = cut, known, most
        self.rare: dict[str, list[str]] = {}
        self.held = 0

    def __missing__(self, unit: str) -> int:
        parts = self.cut.of_unit(unit)
        sure = [self.known.get(p) for p in parts]
        if None in sure:
            self.rare[unit] = [p for p, n in zip(parts, sure) if n is None]
        self.held += len(unit) + 16
        value = self[unit] = sum(n for n in sure if n is not None)
        return value

    def of(self, text: str) -> tuple[int, dict[str, int]]:
        """The tokens that are known of a text, and how often it has each pre-token that is not."""
        if self.held > self.most:  # never inside a text: its rare ones are read at its end
            self.clear()
            self.rare.clear()
            self.held = 0
        count = Counter(self.cut.units(text))
        sure, late = sum(map(mul, map(self.__getitem__, count), count.values())), {}
        for unit in self.rare.keys() & count.keys():
            n = count[unit]
            for piece in self.rare[unit]:
                late[piece] = late.get(piece, 0) + n
        return sure, late


def _load(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def distinct_pre_tokens(docs: DataFrame, rules, flush: int = 350_000, most: int = 64 << 20) -> DataFrame:
    """(unit, n): how often each pre-token occurs.

    A task counts units between white space and cuts each distinct one once a turn; a turn ends at ``flush`` of them or ``most``
    characters of text.
    """

    def run(batches):
        cut, seen, held = PreTokens(rules), Counter(), 0

        def turn():
            out = {}
            for unit, n in seen.items():
                for piece in cut.of_unit(unit):
                    out[piece] = out.get(piece, 0) + n
            return pa.RecordBatch.from_pydict({"unit": pa.array(list(out), pa.string()), "n": pa.array(list(out.values()), pa.int64())})

        for batch in batches:
            for text in batch.column(0):
                if (t := text.as_py()) is not None:
                    seen.update(cut.units(t))
                    held += len(t)
                    if len(seen) >= flush or held >= most:
                        yield turn()
                        seen.clear()
                        held = 0
        if seen:
            yield turn()

    return docs.select("text").mapInArrow(run, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def piece_table(units: DataFrame, path: str) -> DataFrame:
    """``units`` with ``pieces``: the tokens of each pre-token, made once."""

    def count(batch, tok):
        for at in range(0, batch.num_rows, 4096):
            b = batch.slice(at, 4096)
            got = tok.encode_batch(b.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(x.ids) for x in got], pa.int32())], ["unit", "n", "pieces"])

    return map_arrow(units, count, "unit string, n long, pieces int", lambda: _load(path))


def token_counts(docs: DataFrame, path: str, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of ``docs``, without begin, end or added special tokens.

    Null and empty texts have 0 of both. Null doc_ids and repeated rows are counted like others. Texts of any length are read
    whole; rows are told apart by 128 bits of id and text. An empty table gives an empty one. Other columns, whatever their names, are
    not read. A tokenizer whose texts :func:`split_rules` cannot cut counts each distinct text as one piece, so any file gives its own
    numbers.
    """
    rules = split_rules(path)
    table = durable(piece_table(distinct_pre_tokens(docs, rules), path), "pieces")
    # bounded: `hot` rows at most; the order has no ties
    top = table.orderBy(F.col("n").desc(), "unit").limit(hot)
    frame = top.select("unit", "pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast((frame["unit"].to_pylist(), frame["pieces"].to_pylist()))

    def run(batches):
        costs = KnownPieces(PreTokens(rules), dict(zip(*known.value)))
        for batch in batches:
            who, units, counts = [], [], []
            for i, text in enumerate(batch.column(3)):
                sure, late = costs.of(t) if (t := text.as_py()) is not None else (0, {})
                who.extend(repeat(i, len(late) + 1))
                units.extend(late)
                counts.extend(late.values())
                units.append(None)
                counts.append(sure)
            at, unit = pa.array(who, pa.int32()), pa.array(units, pa.string())
            size = pa.compute.binary_length(batch.column(3)).fill_null(0).cast(pa.int64()).take(at)
            size = pa.compute.if_else(unit.is_null(), size, pa.scalar(0, pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(j).take(at) for j in range(3)], unit, pa.array(counts, pa.int64()), size], ["doc_id", "r1", "r2", "unit", "n", "n_bytes"])

    # a row without a unit is a document with what is known of it, the others await their pieces
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *row_keys("doc_id", "text"), "text")
    rows = durable(keyed.mapInArrow(run, "doc_id long, r1 long, r2 long, unit string, n long, n_bytes long"), "frequencies")
    key = ["doc_id", "r1", "r2"]
    sure = rows.where("unit is null").select(*key, "n", "n_bytes", F.lit(1).alias("rows"))
    rare = rows.where("unit is not null").join(table.select("unit", "pieces"), "unit")
    rare = rare.select(*key, (F.col("n") * F.col("pieces")).alias("n"), F.lit(0).cast("long").alias("n_bytes"), F.lit(0).alias("rows"))
    total = sure.unionByName(rare).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("n_bytes").alias("n_bytes"), F.sum("rows").alias("rows"))
    # a row of the table that repeats has been added up; each of its copies gets its share
    total = total.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))))
    return total.select("doc_id", F.expr("n_bytes div rows").alias("n_bytes"), F.expr("n div rows").alias("n_tokens"))
