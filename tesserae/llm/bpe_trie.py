"""BPE encoding and decoding of whole texts over a trie of distinct words.

The distinct pre-tokens of a batch go into a trie; a depth-first walk finds the last token of every node from those of its
ancestors, so a prefix that many words share is encoded once. A word's ids are read back along last tokens from its node.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.bpe import CACHE, Vocabulary, pieces, vocabulary
from tesserae.llm.common import map_rows, texts_of

END = -1


def insert(trie: dict, word: bytes) -> None:
    node = trie
    for b in word:
        node = node.setdefault(b, {})
    node[END] = word


def encode_trie(trie: dict, v: Vocabulary) -> dict[bytes, tuple[int, ...]]:
    """word -> ids for all words of a trie. The stack holds nodes still to be entered; path and last belong to the node entered last."""
    out: dict[bytes, tuple[int, ...]] = {}
    path, last = bytearray(), [0]
    stack = [(0, -1, trie)]
    while stack:
        depth, b, node = stack.pop()
        if depth:
            del path[depth - 1 :], last[depth:]
            path.append(b)
            last.append(v.last_token(bytes(path[-v.longest :]), last, max(0, depth - v.longest)))
        if END in node:
            ids, i = [], depth
            while i:
                ids.append(last[i])
                i -= len(v.bytes_of[last[i]])
            out[node[END]] = tuple(reversed(ids))
        stack += [(depth + 1, c, x) for c, x in node.items() if c != END]
    return out


class Encoder:
    """Texts to ids for one process; ids of frequent words stay, and begin again once there are many."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.known: dict[str, tuple[int, ...]] = {}
        self.decimal = [str(i) for i in range(max(self.v.bytes_of) + 1)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        if len(self.known) > CACHE:
            self.known.clear()
        split = [pieces(t, self.v) for t in texts]
        trie: dict = {}
        for word in set().union(*split):
            if word in self.known:
                continue
            if word in self.v.special:
                self.known[word] = (self.v.special[word],)
            else:
                insert(trie, word.encode())
        self.known |= {w.decode(): ids for w, ids in encode_trie(trie, self.v).items()}
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, words))) for words in split]

    def decode(self, ids: list[int]) -> str:
        """Special tokens kept; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.v.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


#: Characters of text that go through one trie.
AT_ONCE = 2_000_000


def _chunks(texts: list[str]):
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def encode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int>. Null or empty text: no ids. Repeated rows are encoded each; other columns are not read."""

    def make():
        def step(cols):
            e, texts = encoder(vocabulary_path), [x.decode("utf-8", "replace") for x in cols["text"].to_pylist()]
            return {"doc_id": cols["doc_id"], "ids": pa.array([x for part in _chunks(texts) for x in e.encode(part)], pa.list_(pa.int32()))}

        return step

    return map_rows(texts_of(df, id_col, text_col), make, "doc_id long, ids array<int>")


def decode(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text. Null or empty ids: an empty text."""

    def make():
        def step(cols):
            e = encoder(vocabulary_path)
            return {"doc_id": cols["doc_id"], "text": pa.array([e.decode(x or []) for x in cols["ids"].to_pylist()], pa.string())}

        return step

    return map_rows(df.select(df[id_col].cast("long").alias("doc_id"), df[ids_col].cast("array<int>").alias("ids")), make, "doc_id long, text string")


def round_trip(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (the text decoded from those ids), without moving ids or texts between processes."""

    def make():
        def step(cols):
            e, n, a, b = encoder(vocabulary_path), [], [], []
            for part in _chunks([x.decode("utf-8", "replace") for x in cols["text"].to_pylist()]):
                for ids in e.encode(part):
                    n.append(len(ids))
                    a.append(hashlib.sha256(",".join(map(e.decimal.__getitem__, ids)).encode()).hexdigest())
                    b.append(hashlib.sha256(e.decode(ids).encode()).hexdigest())
            return {"doc_id": cols["doc_id"], "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a), "decoded_sha256": pa.array(b)}

        return step

    return map_rows(texts_of(df, id_col, text_col), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
