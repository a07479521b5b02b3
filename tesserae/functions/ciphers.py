"""Byte ciphers of the asset formats; keys are always parameters.

The XOR family is column expressions. Block ciphers work on all blocks of a buffer at once as numpy columns of 32-bit words; rounds
are loops, blocks aren't. Each cipher also encrypts, so that files can be made and round trips tested. They decrypt whole blocks
and leave the tail as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

U32 = np.uint32


def byte_array(data: Column) -> Column:
    """The bytes of a binary column as integers."""
    h = F.hex(data)
    return F.when(F.length(data) == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.length(data) - 1), lambda i: F.conv(F.substring(h, 2 * i + 1, F.lit(2)), 16, 10).cast("int")))


def repeating_xor(data: Column, key: Sequence[int]) -> Column:
    """Each byte (array of integers) with the key byte of its place."""
    k = F.array(*map(F.lit, key))
    return F.transform(data, lambda b, i: b.bitwiseXOR(F.get(k, i % len(key))))


def chained_xor(data: Column, key: Sequence[int], start: int = 0x5E, step: int = 0x3D) -> Column:
    """b ^ key less the chain value, which is start and then the byte before, as it was encrypted, plus step. The chain has encrypted bytes only, so all places are independent."""
    k = F.array(*map(F.lit, key))
    chain = F.concat(F.array(F.lit(start)), F.transform(data, lambda b: (b + step).bitwiseAND(255)))
    return F.transform(data, lambda b, i: (b.bitwiseXOR(F.get(k, i % len(key))) - F.get(chain, i)).bitwiseAND(255))


def _rotl(x, n):
    n = np.asarray(n, dtype=U32) & U32(31)
    return (x << n) | np.where(n > 0, x >> ((U32(32) - n) & U32(31)), U32(0)).astype(U32)


def _rotr(x, n):
    return _rotl(x, (32 - (np.asarray(n, dtype=np.int64) & 31)) & 31)


def on_blocks(data: bytes, size: int, order: str, step: Callable[[list], list]) -> bytes:
    """step maps the word columns of all blocks to new ones."""
    n = len(data) // size * size
    words = np.frombuffer(data[:n], dtype=f"{order}u4").astype(U32).reshape(-1, size // 4)
    with np.errstate(over="ignore"):
        out = np.stack(step([words[:, i].copy() for i in range(size // 4)]), axis=1) if n else words
    return out.astype(f"{order}u4").tobytes() + data[n:]


def tea(data: bytes, key: bytes, decrypt: bool = True) -> bytes:
    """TEA (Wheeler and Needham 1994), 32 cycles, big-endian words."""
    k = np.frombuffer(key, dtype=">u4").astype(U32)
    delta = 0x9E3779B9

    def step(w):
        a, b = w
        for i in range(32, 0, -1) if decrypt else range(1, 33):
            s = U32(delta * i & 0xFFFFFFFF)
            if decrypt:
                b = b - (((a << U32(4)) + k[2]) ^ (a + s) ^ ((a >> U32(5)) + k[3]))
                a = a - (((b << U32(4)) + k[0]) ^ (b + s) ^ ((b >> U32(5)) + k[1]))
            else:
                a = a + (((b << U32(4)) + k[0]) ^ (b + s) ^ ((b >> U32(5)) + k[1]))
                b = b + (((a << U32(4)) + k[2]) ^ (a + s) ^ ((a >> U32(5)) + k[3]))
        return [a, b]

    return on_blocks(data, 8, ">", step)


def _rivest_schedule(key: bytes, n: int) -> list[int]:
    """The mixed key table of RC5 and RC6 (w = 32)."""
    words = [int.from_bytes(key[i : i + 4], "little") for i in range(0, len(key), 4)]
    table = [(0xB7E15163 + 0x9E3779B9 * i) & 0xFFFFFFFF for i in range(n)]
    rot = lambda x, r: ((x << (r & 31)) | (x >> (32 - (r & 31)))) & 0xFFFFFFFF if r & 31 else x
    a = b = 0
    for k in range(3 * max(n, len(words))):
        a = table[k % n] = rot((table[k % n] + a + b) & 0xFFFFFFFF, 3)
        b = words[k % len(words)] = rot((words[k % len(words)] + a + b) & 0xFFFFFFFF, a + b)
    return table


def rc5(data: bytes, key: bytes, rounds: int = 16, decrypt: bool = True) -> bytes:
    """RC5-32 (Rivest 1994)."""
    s = [U32(x) for x in _rivest_schedule(key, 2 * rounds + 2)]

    def step(w):
        a, b = w
        if decrypt:
            for i in range(rounds, 0, -1):
                b = _rotr(b - s[2 * i + 1], a) ^ a
                a = _rotr(a - s[2 * i], b) ^ b
            return [a - s[0], b - s[1]]
        a, b = a + s[0], b + s[1]
        for i in range(1, rounds + 1):
            a = _rotl(a ^ b, b) + s[2 * i]
            b = _rotl(b ^ a, a) + s[2 * i + 1]
        return [a, b]

    return on_blocks(data, 8, "<", step)


def rc6(data: bytes, key: bytes, rounds: int = 20, decrypt: bool = True) -> bytes:
    """RC6-32 (Rivest and others 1998)."""
    s = [U32(x) for x in _rivest_schedule(key, 2 * rounds + 4)]
    mix = lambda x: _rotl(x * (x + x + U32(1)), 5)

    def step(w):
        a, b, c, d = w
        if decrypt:
            c, a = c - s[2 * rounds + 3], a - s[2 * rounds + 2]
            for i in range(rounds, 0, -1):
                a, b, c, d = d, a, b, c
                u, t = mix(d), mix(b)
                c = _rotr(c - s[2 * i + 1], t) ^ u
                a = _rotr(a - s[2 * i], u) ^ t
            return [a, b - s[0], c, d - s[1]]
        b, d = b + s[0], d + s[1]
        for i in range(1, rounds + 1):
            t, u = mix(b), mix(d)
            a = _rotl(a ^ t, u) + s[2 * i]
            c = _rotl(c ^ u, t) + s[2 * i + 1]
            a, b, c, d = b, c, d, a
        return [a + s[2 * rounds + 2], b, c + s[2 * rounds + 3], d]

    return on_blocks(data, 16, "<", step)


#: Key constants of LEA (TTAK.KO-12.0223), the digits of sqrt(766995).
LEA_DELTA = (0xC3EFE9DB, 0x44626B02, 0x79E27C8A, 0x78DF30EC, 0x715EA49E, 0xC785DA0A, 0xE04EF22A, 0xE5C40957)


def lea_schedule(key: bytes) -> list[list[int]]:
    """Round keys of LEA-256: 32 rounds of six words."""
    rot = lambda x, r: ((x << (r & 31)) | (x >> (32 - (r & 31)))) & 0xFFFFFFFF if r & 31 else x
    t = list(np.frombuffer(key, dtype="<u4").astype(int))
    out = []
    for i in range(32):
        d, row = LEA_DELTA[i % 8], []
        for j, r in enumerate((1, 3, 6, 11, 13, 17)):
            at = (6 * i + j) % 8
            t[at] = rot((t[at] + rot(d, i + j)) & 0xFFFFFFFF, r)
            row.append(int(t[at]))
        out.append(row)
    return out


def lea256(data: bytes, key: bytes, decrypt: bool = True) -> bytes:
    """LEA with a 256-bit key (Hong and others 2013)."""
    keys = [[U32(x) for x in row] for row in lea_schedule(key)]

    def step(w):
        x0, x1, x2, x3 = w
        for k in reversed(keys) if decrypt else keys:
            if decrypt:
                y0 = x3
                y1 = (_rotr(x0, 9) - (y0 ^ k[0])) ^ k[1]
                y2 = (_rotl(x1, 5) - (y1 ^ k[2])) ^ k[3]
                y3 = (_rotl(x2, 3) - (y2 ^ k[4])) ^ k[5]
                x0, x1, x2, x3 = y0, y1, y2, y3
            else:
                x0, x1, x2, x3 = _rotl((x0 ^ k[0]) + (x1 ^ k[1]), 9), _rotr((x1 ^ k[2]) + (x2 ^ k[3]), 5), _rotr((x2 ^ k[4]) + (x3 ^ k[5]), 3), x0
        return [x0, x1, x2, x3]

    return on_blocks(data, 16, "<", step)
