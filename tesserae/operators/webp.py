"""Lossless WebP (RFC 9649): each pixel as four prefix codes after green is taken from red and blue; no distances, no colour cache."""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: Fixed values of the format: symbols of the green, red, blue and alpha codes, the order of the code lengths of code lengths.
ALPHABETS = (280, 256, 256, 256)
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LONGEST_CODE, LARGEST_SIDE = 15, 1 << 14


def code_lengths(counts: np.ndarray, longest: int = LONGEST_CODE) -> np.ndarray:
    """Lengths of a Huffman code over the symbols that occur, none over longest: counts are flattened until the tree is shallow enough. One symbol alone has length 0."""
    counts = np.asarray(counts, np.int64)
    while True:
        heap = [(int(n), k, (k,)) for k, n in enumerate(counts) if n]
        heapq.heapify(heap)
        out = np.zeros(len(counts), np.int64)
        while len(heap) > 1:
            (n, k, a), (m, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            out[list(a + b)] += 1
            heapq.heappush(heap, (n + m, k, a + b))
        if out.max(initial=0) <= longest:
            return out
        counts = (counts + 1) // 2


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by length and symbol, bits reversed, for a stream is read from its lowest bit."""
    codes, code, last = np.zeros(len(lengths), np.int64), 0, 0
    for k in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[k])
        if n:
            code <<= n - last
            codes[k], last = int(f"{code:0{n}b}"[::-1], 2), n
            code += 1
    return codes


def to_bits(values, widths) -> np.ndarray:
    """Each value's lowest so many bits, one after another."""
    values, widths = np.asarray(values, np.int64), np.asarray(widths, np.int64)
    ends = np.cumsum(widths)
    place = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - widths, widths)
    return (np.repeat(values, widths) >> place & 1).astype(np.uint8)


def code_header(lengths: np.ndarray, only: int | None) -> list[tuple[int, int]]:
    """A lone symbol by its number; else all lengths, each in four bits by a code of sixteen equal lengths."""
    if only is not None:
        return [(1, 1), (0, 1), (1, 1), (only, 8)]
    head = [(0, 1), (len(LENGTH_ORDER) - 4, 4)] + [(4 if k < 16 else 0, 3) for k in LENGTH_ORDER] + [(0, 1)]
    plain = canonical(np.full(16, 4))
    return head + [(int(plain[n]), 4) for n in lengths]


def webp(img: np.ndarray) -> bytes:
    """img (rows, columns, RGBA bytes) as a file that decodes to exactly these bytes, colours under transparent pixels too. Sides are 1 to 16,384."""
    height, width = img.shape[:2]
    if not (0 < width <= LARGEST_SIDE and 0 < height <= LARGEST_SIDE):
        raise ValueError(f"no WebP of {width} x {height}")
    r, g, b, a = (img[..., k].ravel().astype(np.int64) for k in range(4))
    channels = (g, (r - g) & 255, (b - g) & 255, a)
    head = [(0x2F, 8), (width - 1, 14), (height - 1, 14), (int((a < 255).any()), 1), (0, 3), (1, 1), (2, 2), (0, 1), (0, 1), (0, 1)]
    values, widths = np.empty((len(g), 4), np.int64), np.empty((len(g), 4), np.int64)
    for k, (channel, size) in enumerate(zip(channels, ALPHABETS, strict=True)):
        counts = np.bincount(channel, minlength=size)
        lengths = code_lengths(counts)
        head += code_header(lengths, int(counts.argmax()) if np.count_nonzero(counts) == 1 else None)
        values[:, k], widths[:, k] = canonical(lengths)[channel], lengths[channel]
    head += [(1, 1), (0, 1), (0, 1), (0, 1)]  # the code of distances, which don't occur
    data = np.packbits(np.concatenate((to_bits(*zip(*head, strict=True)), to_bits(values.ravel(), widths.ravel()))), bitorder="little").tobytes()
    chunk = b"VP8L" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
