"""Best-fit-decreasing packing of token sequences into windows.

A document's ids are cut into full windows and one rest. Best fit decreasing looks at lengths alone, and there are at most as many
lengths as a window has tokens: the driver packs the histogram of lengths, with windows of one filling moved as ranges, so its work
and memory depend on the window and not on the corpus. A segment tree over remaining capacity finds the tightest open range. The
plan is a list of runs (a length, its ranks, where they go); a piece finds its run by its rank among the pieces of its length, which
tasks count by themselves and a sum over tasks makes global.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import deque
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.bpe import byte_chars, pieces
from tesserae.llm.common import cut, map_rows, texts_of

END = b"\0\0\0\0"
#: Words in each of the two halves of a task's cache.
RECENT = 200_000
#: The characters that byte-level models have for bytes.
CHARS = {b: c for c, b in byte_chars().items()}


class Tightest:
    """A segment tree over capacities 0..size that counts open windows: the least capacity of at least so much that has one."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, n: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += n
            i >>= 1

    def find(self, least: int) -> int | None:
        i = least + self.leaves
        if self.count[i]:
            return least
        while i > 1 and (i & 1 or not self.count[i + 1]):  # up until a right neighbour has one
            i >>= 1
        if i <= 1:
            return None
        i += 1
        while i < self.leaves:
            i = 2 * i if self.count[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(counts: np.ndarray, window: int) -> np.ndarray:
    """Best fit decreasing over counts[length]. Rows (length, first rank, windows, pieces a window, first sequence, offset): pieces
    of that length with ranks from the first on go to so many sequences, so many to each, from that offset.

    The tightest window that takes a piece stays the tightest until the next such piece no longer fits, so all windows of one
    capacity are filled alike, and a range is split at most once a length.
    """
    tree, open_, runs, sequences = Tightest(window), [deque() for _ in range(window + 1)], [], 0

    def put(first: int, n: int, capacity: int, front: bool = False) -> None:
        if n and capacity:
            (open_[capacity].appendleft if front else open_[capacity].append)((first, n))
            tree.add(capacity, n)

    for length in range(window, 0, -1):
        left, rank = int(counts[length]), 0
        while left:
            capacity = tree.find(length)
            if capacity is None:
                capacity, n = window, -(-left // (window // length))
                first = sequences
                sequences += n
            else:
                first, n = open_[capacity].popleft()
                tree.add(capacity, -n)
            each = capacity // length
            use, each = (min(n, left // each), each) if left >= each else (1, left)
            runs.append((length, rank, use, each, first, window - capacity))
            rank, left = rank + use * each, left - use * each
            put(first + use, n - use, capacity, front=True)
            put(first, use, capacity - each * length)
    return np.array(runs, dtype=np.int64).reshape(-1, 6)


class Ids(dict):
    """pre-token -> its ids by the tokenizers library, as little-endian unsigned 32-bit numbers.

    The library's model is asked directly, for a pre-token needs no splitting; that takes half the time of its whole encode.
    At most twice RECENT words are held: when so many are new, those before them go, but for the words that came up again. special
    and split_special are what bpe.pieces asks of a vocabulary, which needn't be read here.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {t.content: k for k, t in self.library.get_added_tokens_decoder().items()}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.model, self.before = self.library.model, {}

    def __missing__(self, word: str) -> bytes:
        if (out := self.before.get(word)) is None:
            found = [self.special[word]] if word in self.special else [t.id for t in self.model.tokenize(word.encode().decode("latin-1").translate(CHARS))]
            out = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= 64:
            if len(self) >= RECENT:
                self.before = dict(self)
                self.clear()
            self[word] = out
        return out


@lru_cache(maxsize=4)
def ids_for(path: str) -> Ids:
    """One a process, its library too: a new one for each task or full cache would leave its memory behind."""
    return Ids(path)


def document_ids(text: str, path: str) -> bytes:
    """A document's ids and the closing 0. The library splits a text in the same pre-tokens, so its parts encode as they do in it."""
    ids = ids_for(path)
    return b"".join(map(ids.__getitem__, pieces(text, ids))) + END


def cut_pieces(df: DataFrame, vocabulary_path: str, window: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, and task, rank: the piece is that one of its length within its task."""

    def make():
        seen, task = [0] * (window + 1), TaskContext.get().partitionId()

        def step(cols):
            rows = []
            for doc, raw in zip(cols["doc_id"].to_pylist(), cols["text"].to_pylist(), strict=True):
                ids = document_ids(raw.decode("utf-8", "replace"), vocabulary_path)
                total = len(ids) // 4
                for start in range(0, total, window):
                    n = min(window, total - start)
                    rows.append((doc, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), total, task, seen[n]))
                    seen[n] += 1
            doc, *rest = zip(*rows, strict=True)
            names = ("start", "length", "ids_crc32", "doc_tokens", "task", "rank")
            return {"doc_id": pa.array(doc, pa.int64())} | {k: pa.array(x, pa.int64()) for k, x in zip(names, rest, strict=True)}

        return step

    return map_rows(texts_of(df, id_col, text_col), make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, rank long")


def pack(df: DataFrame, vocabulary_path: str, window: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the closing id alone. Repeated rows and null ids are packed like any other. An empty table gives no
    row. Which of several pieces of one length goes where is arbitrary, and fixed once the pieces are written.
    """
    parts = cut(cut_pieces(df, vocabulary_path, window, id_col, text_col), "pieces")
    by_task = cut(parts.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = np.zeros(window + 1, dtype=np.int64)
    for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row a length
        counts[r.length] = r.n
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    ranked = parts.join(by_task.select("length", "task", F.coalesce(before, F.lit(0)).alias("base")), ["length", "task"])
    held = df.sparkSession.sparkContext.broadcast(plan(counts, window))

    def make():
        runs = held.value
        key = runs[:, 0] << 44 | runs[:, 1]
        order = np.argsort(key)
        runs, key = runs[order], key[order]

        def step(cols):
            length, rank = (cols[k].to_numpy() for k in ("length", "rank"))
            rank = rank + cols["base"].to_numpy()
            r = runs[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            at = rank - r[:, 1]
            return {k: cols[k] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")} | {"sequence_id": pa.array(r[:, 4] + at // r[:, 3]), "offset": pa.array(r[:, 5] + at % r[:, 3] * length)}

        return step

    return map_rows(ranked, make, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
