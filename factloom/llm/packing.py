"""Best-fit packing of tokenized documents into sequences of bounded length.

Documents become ids and a closing id; longer ones are cut into full pieces behind a first piece that may be shorter. Pieces are
packed online: a fixed number of bins is open, a bitset tells which free spaces occur among them, a piece goes where it leaves the
least space, and when none of the open bins has room and no more may be opened the fullest is closed.
"""

from __future__ import annotations

import json
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 2048
OPEN_BINS = 1024
#: Documents a packing task gets, about.
PACK_ROWS = 100_000


#: Fixed value: the split pattern that byte-level tokenizers use where their file asks for the pattern of its own.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_ranks(path: str) -> dict[bytes, int] | None:
    """The vocabulary of a byte-level tokenizer as bytes to rank; None where its file asks for more than the plain pattern or its merges are not in the order of its ids."""
    with open(path, encoding="utf-8") as f:
        kept = json.load(f)
    model, pre = kept["model"], kept.get("pre_tokenizer") or {}
    if kept.get("normalizer") or pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or model.get("dropout"):
        return None
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    back = {c: b for b, c in shown.items()}
    vocab, merges = model["vocab"], model["merges"]
    for i, m in enumerate(merges):
        a, b = m.split(" ") if isinstance(m, str) else m
        if vocab.get(a + b) != 256 + i:
            return None
    return {bytes(back[c] for c in token): n for token, n in vocab.items() if n < 256 + len(merges)}


class Encoder:
    """Token ids of a text as little-endian unsigned 32-bit bytes, as the tokenizer in ``path`` gives them without special tokens added.

    Texts split at single spaces into units that the byte-level pattern never joins, so ids of units are remembered and put
    together. New units go through a faster library with the same ranks, and those with a special string, like texts with other
    white space next to a space, to the tokenizer itself.
    """

    def __init__(self, path: str, most: int = 200_000):
        import os
        import re

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.whole = re.compile(r" [\s\x1c-\x1f]").search
        self.seen: dict[str, bytes] = {}
        # without ranks nothing is known of where texts can be cut: the tokenizer gets them whole
        self.most, self.fast = most, None
        if ranks := byte_ranks(path):
            import tiktoken

            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    def _slow(self, text: str) -> bytes:
        return np.asarray(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids(self, text: str) -> bytes:
        if self.fast is None or any(s in text for s in self.special):
            return self._slow(text)
        return array("I", self.fast(text)).tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or self.whole(text):
            return self._ids(text)
        seen = self.seen
        head, *rest = text.split(" ")
        out = [self._ids(head)] if head else []
        for w in rest:
            ids = seen.get(w)
            if ids is None:
                if len(seen) >= self.most:
                    seen.clear()
                ids = seen[w] = self._ids(" " + w)
            out.append(ids)
        return b"".join(out)


def piece_lengths(n: int, most: int) -> list[int]:
    """``n`` tokens as one piece, or the remainder first and then full pieces."""
    if n <= most:
        return [n]
    first = n % most
    return ([first] if first else []) + [most] * (n // most)


class BestFit:
    """Online best-fit with a fixed number of open bins.

    ``spaces`` has bit f set if an open bin has f tokens free; ``bins[f]`` holds those bins' numbers. Bins without space close at once.
    """

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.spaces, self.open, self.next = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        held = self.bins[free]
        number = held.pop()
        if not held:
            self.spaces &= ~(1 << free)
        return number

    def add(self, length: int) -> tuple[int, int]:
        """The bin that ``length`` tokens go to and the tokens in it before."""
        fitting = self.spaces >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.open == self.most_open:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
                self.open -= 1
            number, free = self.next, self.capacity
            self.next += 1
            self.open += 1
        left = free - length
        if left:
            self.bins[left].append(number)
            self.spaces |= 1 << left
        else:
            self.open -= 1
        return number, self.capacity - free


def token_pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of each document with its closing ``end_id``."""
    tail = int(end_id).to_bytes(4, "little")

    def run(batches):
        enc = Encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                cols: list[list] = [[], [], [], [], []]
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = enc.encode(text or "") + tail
                    start = 0
                    for k, n in enumerate(piece_lengths(len(ids) // 4, length)):
                        for col, v in zip(cols, (key, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]))):
                            col.append(v)
                        start += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, length: int = LENGTH, most_open: int = OPEN_BINS, groups: int = 1) -> DataFrame:
    """``pieces``, rows of :func:`token_pieces`, with ``sequence_id`` and ``offset``; each of ``groups`` shares is packed by itself, in a fixed order.

    Null doc_ids and repeated rows are packed like others; of equal rows it makes no difference which goes where. An empty table gives
    an empty one. A length above ``length`` is a fault of the caller.
    """
    spread = F.xxhash64("doc_id", "piece", "ids_crc32")
    dealt = pieces.withColumn("spread", spread).repartition(groups, "spread").sortWithinPartitions("spread", "doc_id", "piece", "start", "length")

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        bins = BestFit(length, most_open)
        for batch in batches:
            got = [bins.add(n) for n in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([base + b for b, _ in got], pa.int64()), pa.array([o for _, o in got], pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, length: int = LENGTH, most_open: int = OPEN_BINS, end_id: int = 0, pack_rows: int = PACK_ROWS) -> DataFrame:
    """Every document of ``docs`` cut and packed: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Null texts are empty: one piece that holds the closing id. Null doc_ids and repeated rows are packed like others. Texts of any
    length are encoded whole. An empty table gives an empty one. Other columns are not read. The order of packing is that of a
    hash of the piece, so reruns agree.
    """
    groups = max(1, round(docs.count() / pack_rows))
    return pack(token_pieces(docs, path, length, end_id), length, most_open, groups)
