"""Exact token counts of texts and of all their prefixes, by prefix dynamic programming.

For a pre-token, counts[i] is the number of tokens of its first i bytes: one more than counts[j], where the last token of those i
bytes begins at j. A text's index is the running sum over its pre-tokens, so a prefix is one lookup and a few steps in one
pre-token; a budget is a search in the same numbers. Nothing is encoded again.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.llm.bpe import CACHE, Vocabulary, pieces, vocabulary
from tesserae.llm.common import map_rows, texts_of

#: Whitespace of the split pattern.
SPACE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


class Counts(dict):
    """pre-token -> counts of all its byte prefixes, as bytes while they are below 256 (a tuple beyond)."""

    def __init__(self, v: Vocabulary):
        self.v, self.total = v, Totals(self)

    def __missing__(self, word: str):
        if word in self.v.special:
            return (0, 1)
        raw = word.encode()
        counts = self.v.prefixes(raw)
        out = bytes(counts) if max(counts) < 256 else tuple(counts)
        if len(raw) <= 64:
            self[word] = out
        return out


class Totals(dict):
    """pre-token -> its number of tokens."""

    def __init__(self, counts: Counts):
        self.counts = counts

    def __missing__(self, word: str) -> int:
        n = self.counts[word][-1]
        if len(word) <= 64:
            self[word] = n
        return n


_COUNTS: dict[str, Counts] = {}


def counts_for(path: str) -> Counts:
    """The process's table for a vocabulary, begun again once it is large."""
    c = _COUNTS.get(path)
    if c is None or len(c) > CACHE:
        c = _COUNTS[path] = Counts(vocabulary(path))
    return c


class PrefixIndex:
    """Token counts of all prefixes of a text."""

    def __init__(self, text: str, path: str):
        self.text, self.c = text, counts_for(path)
        self.words = pieces(text, self.c.v)
        self.ends = list(accumulate(map(len, self.words)))
        self.sums = list(accumulate(map(self.c.total.__getitem__, self.words)))

    def __len__(self) -> int:
        return self.sums[-1] if self.sums else 0

    def count(self, k: int) -> int:
        """Tokens of text[:k] as a text of its own. Only what the cut touches differs from the whole: the pre-token it falls in, or the run of whitespace before it."""
        if k <= 0:
            return 0
        i = bisect_right(self.ends, k - 1)  # the pre-token that holds character k - 1
        if i >= len(self.ends):
            return len(self)
        start = self.ends[i - 1] if i else 0
        if self.text[k - 1] in SPACE:
            while i and self.text[start] in SPACE and self.text[start:k].strip("".join(SPACE)) == "" and self.words[i - 1][-1] in SPACE:
                i -= 1
                start = self.ends[i - 1] if i else 0
        elif k == self.ends[i]:
            return self.sums[i]
        elif self.words[i] in self.c.v.special and i and self.words[i - 1] not in self.c.v.special:
            i -= 1  # a special token cut short is plain text and may go on from the pre-token before
            start = self.ends[i - 1] if i else 0
        done = self.sums[i - 1] if i else 0
        part = self.text[start:k]
        if self.words[i].startswith(part) and part[0] != "'" and self.words[i] not in self.c.v.special:
            return done + self.c[self.words[i]][len(part.encode())]
        return done + sum(map(self.c.total.__getitem__, pieces(part, self.c.v)))

    def fit(self, budget: int) -> int:
        """Characters of the longest prefix of at most budget tokens."""
        if len(self) <= budget:
            return len(self.text)
        i = bisect_right(self.sums, budget)  # the first pre-token whose end is over it
        at = self.ends[i - 1] if i else 0
        best = at
        while i < len(self.ends):  # a cut within the next pre-token, or in the whitespace after, can still fit
            for k in range(at + 1, self.ends[i] + 1):
                if self.count(k) <= budget:
                    best = k
            if best < self.ends[i] or self.words[i][-1] not in SPACE:
                break
            at = self.ends[i]
            i += 1
        return best


def token_counts(df: DataFrame, vocabulary_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a row: doc_id, n_bytes, n_tokens, over_limit, fit_bytes (UTF-8 bytes of the longest prefix within the limit).

    Null or empty text: 0 tokens, not over. A null id stays. Repeated rows are counted each. Other columns are not read.
    """

    def make():
        def step(cols):
            n, size, fit = [], [], []
            for raw in cols["text"].to_pylist():
                text = raw.decode("utf-8", "replace")
                c = counts_for(vocabulary_path)
                total = sum(map(c.total.__getitem__, pieces(text, c.v)))
                n.append(total)
                size.append(len(raw))
                fit.append(len(raw) if total <= limit else _fit_bytes(text, vocabulary_path, limit))
            return {"doc_id": cols["doc_id"], "n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "over_limit": pa.array([x > limit for x in n]), "fit_bytes": pa.array(fit, pa.int64())}

        return step

    return map_rows(texts_of(df, id_col, text_col), make, "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_bytes long")


def _fit_bytes(text: str, path: str, limit: int) -> int:
    """The prefix that fits lies within the first pre-tokens: a token has a byte at least, so the index of a little more than the limit's longest tokens says it all."""
    v = counts_for(path).v
    head = text[: (limit + 2) * v.longest]
    return len(head[: PrefixIndex(head, path).fit(limit)].encode())


def prefix_counts(df: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored form: doc_id, ends array<int> (characters up to the end of each pre-token), tokens array<int> (tokens up to there). Null text: empty arrays."""

    def make():
        def step(cols):
            found = [PrefixIndex(raw.decode("utf-8", "replace"), vocabulary_path) for raw in cols["text"].to_pylist()]
            return {"doc_id": cols["doc_id"], "ends": pa.array([x.ends for x in found], pa.list_(pa.int32())), "tokens": pa.array([x.sums for x in found], pa.list_(pa.int32()))}

        return step

    return map_rows(texts_of(df, id_col, text_col), make, "doc_id long, ends array<int>, tokens array<int>")
