"""Byte-level BPE shared by the token operators: the vocabulary, the split into pre-tokens and the last-token rule.

The rule: a sequence of tokens is what the merges make of its bytes exactly if each token is what they make of its own bytes and
each two neighbours are what they make of both. So the tokens of a prefix end in the one token t for which this holds against the
last token of the prefix before t, and a prefix needs no more state than its last token.
"""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import ahocorasick
import regex

#: The split of byte-level BPE vocabularies of this kind, as their tokenizer files name it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts below U+0250, where the three classes are short ranges and the standard library's engine is several times faster.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_NARROW = re.compile(f" ?[{_L}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_WIDE = regex.compile(PATTERN)
_BEYOND = re.compile("[^\x00-ɏ]")
#: Words kept in a cache before it starts again; common words are back at once.
CACHE = 500_000


def byte_chars() -> dict[str, int]:
    """The printable character for each byte in byte-level vocabulary files: printable Latin-1 stands for itself, the others follow U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A tokenizer file of byte-level BPE. ids: bytes to id; bytes_of: id to bytes; special: added token to id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        as_bytes = lambda s: bytes(chars[c] for c in s)
        self.ids = {as_bytes(k): v for k, v in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {v: k for k, v in self.ids.items()} | {v: k.encode() for k, v in self.special.items()}
        self.longest = max(map(len, self.ids))
        self.rank = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            a, b = self.ids[as_bytes(a)], self.ids[as_bytes(b)]
            self.rank[a, b] = (i, self.ids[self.bytes_of[a] + self.bytes_of[b]])
        self.sound: dict[int, bool] = {}
        self.fits: dict[int, bool] = {}
        self.made = {t: (i, a, b) for (a, b), (i, t) in reversed(self.rank.items())}
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None

    @cached_property
    def tails(self) -> dict[bytes, int]:
        """Every ending of every token: its id, or -1 where it is an ending only."""
        return {k[i:]: -1 for k in self.ids for i in range(len(k))} | self.ids

    @cached_property
    def finder(self) -> ahocorasick.Automaton:
        """Finds all tokens within a text whose characters stand for bytes; a find is (id, length)."""
        out = ahocorasick.Automaton()
        for k, t in self.ids.items():
            out.add_word(k.decode("latin-1"), (t, len(k)))
        out.make_automaton()
        return out

    def merged(self, piece: bytes) -> list[int]:
        """The merges, one by one in the order of their ranks; used on single tokens only."""
        out = [self.ids[piece[i : i + 1]] for i in range(len(piece))]
        while found := [(self.rank[p], i) for i, p in enumerate(zip(out, out[1:], strict=False)) if p in self.rank]:
            (_, t), i = min(found)
            out[i : i + 2] = [t]
        return out

    def is_sound(self, t: int) -> bool:
        if (ok := self.sound.get(t)) is None:
            ok = self.sound[t] = self.merged(self.bytes_of[t]) == [t]
        return ok

    def edge(self, t: int, side: int) -> list[tuple[int, float]]:
        """What stands at the left (1) or right (2) end of t while it is being merged: token, and rank of the merge that takes it in."""
        out, until = [], float("inf")
        while True:
            out.append((t, until))
            if t not in self.made:
                return out
            until, t = self.made[t][0], self.made[t][side]

    def is_next(self, a: int, b: int) -> bool:
        """Whether a and b stay apart: no pair that meets at their border merges while both of it stand there. Of equal merges the left one goes first."""
        key = a << 32 | b
        if (ok := self.fits.get(key)) is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            ok = self.is_sound(b) and not any((m := self.rank.get((x, y))) and m[0] < till and m[0] <= until for x, till in self.edge(a, 2) for y, until in self.edge(b, 1))
            self.fits[key] = ok
        return ok

    def last_token(self, tail: bytes, last: list[int], start: int = 0) -> int:
        """The last token of a prefix that ends in tail, which begins at byte start and is the whole prefix or as long as the longest token; last[i]: that of its first i bytes (last[0] unused)."""
        tails, fits = self.tails, self.fits
        for k in range(len(tail) - 1, -1, -1):
            t, j = tails.get(tail[k:]), start + k
            if t is None:
                break
            if t >= 0 and ((fits[key] if (key := last[j] << 32 | t) in fits else self.is_next(last[j], t)) if j else self.is_sound(t)):
                return t
        raise ValueError("no token ends here")

    def prefixes(self, word: bytes) -> list[int]:
        """Token counts of all prefixes of a pre-token, the empty one first: each from the prefix before its last token."""
        fits = self.fits
        last, counts = [-1] * (len(word) + 1), [0] * (len(word) + 1)
        for end, (t, n) in self.finder.iter(word.decode("latin-1")):
            end += 1
            if last[end] < 0:
                j = end - n
                if (fits[key] if (key := last[j] << 32 | t) in fits else self.is_next(last[j], t)) if j else self.is_sound(t):
                    last[end], counts[end] = t, counts[j] + 1
        return counts


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One a process: tasks of one Python worker share it and what it remembers."""
    return Vocabulary(path)


def pretokens(text: str) -> list[str]:
    return (_WIDE if _BEYOND.search(text) else _NARROW).findall(text)


def pieces(text: str, v: Vocabulary) -> list[str]:
    """Pre-tokens of a text, special tokens in it as they are."""
    if v.split_special is None or not any(s in text for s in v.special):
        return pretokens(text)
    out = []
    for i, x in enumerate(v.split_special.split(text)):
        out += [x] if i % 2 else pretokens(x)
    return out
