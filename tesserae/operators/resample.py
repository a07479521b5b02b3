"""Resampling and image output: Arrow kernels, one image at a time, over tables of whole images (width, height, rgba).

Cubic weights are those of Keys with a = -1/2, widened when an image shrinks; both axes are matrix products. Agreement with other
implementations of the same cubic is to a rounding step and not to the bit.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tesserae.operators.webp import webp


def cubic(t: np.ndarray) -> np.ndarray:
    t = np.abs(t)
    return np.where(t < 1, 1 + t * t * (1.5 * t - 2.5), np.where(t < 2, 2 + t * (-4 + t * (2.5 - 0.5 * t)), 0.0))


def weights(source: int, target: int) -> np.ndarray:
    """Rows that sum to one: the share of each source place in each target place."""
    ratio = source / target
    wide = max(1.0, ratio)
    w = cubic(((np.arange(source) + 0.5)[None, :] - ((np.arange(target) + 0.5) * ratio)[:, None]) / wide)
    return w / w.sum(axis=1, keepdims=True)


def round8(v: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(v, 0, 255) + 0.5).clip(0, 255).astype(np.uint8)


def premultiply(img: np.ndarray) -> np.ndarray:
    out = img.astype(np.float64)
    out[..., :3] = np.floor(out[..., :3] * (out[..., 3:] / 255.0) + 0.5)
    return out


def unpremultiply(img: np.ndarray) -> np.ndarray:
    """Colours of pixels with an alpha of 1 or less are zero."""
    a = img[..., 3:].astype(np.float64)
    out = img.copy()
    out[..., :3] = np.where(a > 1, round8(img[..., :3] * (255.0 / np.maximum(a, 1))), 0)
    return out


def resize(img: np.ndarray, width: int, height: int, masked: bool = False) -> np.ndarray:
    """An RGBA image in other dimensions; colours are weighed by alpha on the way, and masked weighs colours and alpha by alpha once more."""
    source = premultiply(img) * (img[..., 3:] / 255.0 if masked else 1.0)
    out = np.einsum("ys,sxc->yxc", weights(img.shape[0], height), source)
    out = np.einsum("xs,ysc->yxc", weights(img.shape[1], width), out)
    out[..., :3] = np.minimum(out[..., :3], out[..., 3:])
    return unpremultiply(round8(out))


def downsample(img: np.ndarray, width: int, height: int) -> np.ndarray:
    """A supersampled image to its size; one that is no larger stays."""
    return img if img.shape[1] <= width and img.shape[0] <= height else resize(img, width, height)


def crop_alpha(img: np.ndarray) -> np.ndarray:
    """To the visible box; one that is a pixel wide or high leaves the image as it is."""
    ys, xs = np.nonzero(img[..., 3])
    if not len(xs) or xs.max() <= xs.min() or ys.max() <= ys.min():
        return img
    return img[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]


def scale_and_centre(img: np.ndarray, width: int, height: int, fill: float) -> np.ndarray:
    """Scaled to a share of the canvas by the axis that allows less, and placed in its middle."""
    canvas = np.zeros((height, width, 4), np.uint8)
    if not img.shape[0] or not img.shape[1]:
        return canvas
    f = min(width * fill / img.shape[1], height * fill / img.shape[0])
    w, h = (max(1, int(n * f + 0.5)) for n in (img.shape[1], img.shape[0]))
    x, y = (width - w) // 2, (height - h) // 2
    canvas[y : y + h, x : x + w] = resize(img, w, h)[: height - y, : width - x]
    return canvas


def crop_and_centre(img: np.ndarray, width: int, height: int, fill: float) -> np.ndarray:
    return scale_and_centre(crop_alpha(img), width, height, fill)


def trim(img: np.ndarray, width: int, height: int, padding: int = 4) -> np.ndarray:
    """Fills the canvas but for the padding; content that nearly does so already leaves the image uncropped."""
    cropped, least = crop_alpha(img), min(width, height)
    if max(cropped.shape[:2]) >= least - 2 * padding:
        return img
    return scale_and_centre(cropped, width, height, (least - 2 * padding) / least)


def rotate(img: np.ndarray, degrees: float) -> np.ndarray:
    """Turned about its middle on a canvas that holds it, clockwise as seen. Each place takes the four around its origin in straight colours; places whose four aren't all inside stay empty. Turns under half a degree change nothing."""
    if abs(degrees) < 0.5:
        return img
    (h, w), c, s = img.shape[:2], math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    width, height = math.ceil(w * abs(c) + h * abs(s)), math.ceil(w * abs(s) + h * abs(c))
    x, y = np.arange(width)[None, :] - width / 2, np.arange(height)[:, None] - height / 2
    fx, fy = x * c + y * s + w / 2, -x * s + y * c + h / 2
    x0, y0 = np.floor(fx).astype(int), np.floor(fy).astype(int)
    inside = (x0 >= 0) & (y0 >= 0) & (x0 + 1 < w) & (y0 + 1 < h)
    x0, y0, fx, fy = (v[inside] for v in (x0, y0, fx, fy))
    fx, fy, src = (fx - x0)[:, None], (fy - y0)[:, None], img.astype(np.float64)
    out = np.zeros((height, width, 4), np.uint8)
    out[inside] = round8((1 - fy) * ((1 - fx) * src[y0, x0] + fx * src[y0, x0 + 1]) + fy * ((1 - fx) * src[y0 + 1, x0] + fx * src[y0 + 1, x0 + 1]))
    return out


def main_axis(xs: np.ndarray, ys: np.ndarray) -> float:
    """Degrees of the direction in which places spread most, rows counted downwards; along an axis where they hardly vary together."""
    n, sx, sy = len(xs), int(xs.sum()), int(ys.sum())
    a, b, d = ((n * int((u * v).sum()) - su * sv) / (n * n) for u, v, su, sv in ((xs, xs, sx, sx), (xs, ys, sx, sy), (ys, ys, sy, sy)))
    if abs(b) < 1e-9:
        return 0.0 if a >= d else 90.0
    return math.degrees(math.atan2(b, (a - d) / 2 + math.hypot((a - d) / 2, b)))


def wide_end_ahead(img: np.ndarray, degrees: float) -> bool:
    """Whether the visible half ahead of the visible box's middle, the dividing line included, spreads over 1.2 times as wide across the direction as the half behind; halves under 10 pixels have no spread, images under 20 no answer."""
    ys, xs = np.nonzero(img[..., 3])
    if len(xs) < 20:
        return False
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    x, y = xs - (xs.min() + xs.max()) / 2, ys - (ys.min() + ys.max()) / 2
    ahead, across = np.round(x * c + y * s, 6) >= 0, y * c - x * s
    spread = lambda v: v.std() if len(v) >= 10 else 0.0
    return bool(spread(across[ahead]) > 1.2 * spread(across[~ahead]))


def standardise(img: np.ndarray, width: int, height: int, degrees: float, fill: float, turned: bool = False) -> np.ndarray:
    """Main axis to degrees (counted upwards), wide end to the upper left (turned: the other end), cropped, scaled and centred. Images under 10 visible pixels stay."""
    ys, xs = np.nonzero(img[..., 3])
    if len(xs) < 10:
        return img
    turn = -degrees - main_axis(xs, ys)
    turn -= 180 * (math.ceil((turn - 90) / 180) if turn > 90 else math.floor((turn + 90) / 180) if turn < -90 else 0)
    out = rotate(img, turn)
    if wide_end_ahead(out, -degrees) != turned:
        out = out[::-1, ::-1]
    return crop_and_centre(out, width, height, fill)


def largest_part(img: np.ndarray) -> np.ndarray:
    """Only the largest part of visible pixels that touch in eight directions, the first in reading order among equals. Labels fall to the least neighbour's, roots follow, until none changes."""
    on = img[..., 3] > 0
    n = on.size
    label = np.append(np.where(on.ravel(), np.arange(n), n), n)
    while True:
        p = np.pad(label[:n].reshape(on.shape), 1, constant_values=n)
        least = np.minimum.reduce([p[1 + dy : 1 + dy + on.shape[0], 1 + dx : 1 + dx + on.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)])[on]
        new = label.copy()
        np.minimum.at(new, label[:n][on.ravel()], least)
        while ((further := new[new]) != new).any():
            new = further
        if (new == label).all():
            break
        label = new
    if not on.any():
        return img
    keep = label[:n] == np.bincount(label[:n][on.ravel()], minlength=n).argmax()
    return np.where(keep.reshape(on.shape)[..., None], img, 0).astype(np.uint8)


def mirror_pair(img: np.ndarray, width: int, height: int, fill: float) -> np.ndarray:
    """The largest part and its mirror image side by side, a twenty-fifth of its width apart, scaled under its own alpha as a mask and centred; sizes are cut to whole pixels."""
    part = crop_alpha(largest_part(img))
    gap = np.zeros((part.shape[0], max(1, part.shape[1] // 25), 4), np.uint8)
    pair = np.concatenate((part, gap, part[:, ::-1]), axis=1)
    f = min(width * fill / pair.shape[1], height * fill / pair.shape[0])
    w, h = (max(1, int(n * f)) for n in (pair.shape[1], pair.shape[0]))
    x, y = (width - w) // 2, (height - h) // 2
    canvas = np.zeros((height, width, 4), np.uint8)
    canvas[y : y + h, x : x + w] = resize(pair, w, h, masked=True)
    return canvas


def background_removed(img: np.ndarray, threshold: int) -> np.ndarray:
    """Alpha zero for dark or transparent pixels that the border reaches in four directions; then up to three rounds that fade dark pixels beside nothing, each from the state before it."""
    bright, alpha = img[..., :3].astype(int).sum(axis=2) // 3, img[..., 3].astype(int)
    dark = (alpha == 0) | (bright < threshold)
    reach = np.zeros_like(dark)
    reach[[0, -1], :], reach[:, [0, -1]] = dark[[0, -1], :], dark[:, [0, -1]]
    beside = lambda m, edge: np.logical_or.reduce([p[1 + dy : 1 + dy + m.shape[0], 1 + dx : 1 + dx + m.shape[1]] for p in [np.pad(m, 1, constant_values=edge)] for dy, dx in ((0, 1), (0, -1), (1, 0), (-1, 0))])
    while (more := dark & ~reach & beside(reach, False)).any():
        reach |= more
    alpha[reach] = 0
    for _ in range(3):
        fade = (alpha > 0) & (bright < 2 * threshold) & beside(alpha == 0, True)
        if not fade.any():
            break
        alpha = np.where(fade, alpha * bright // (2 * threshold), alpha)
    return np.dstack((img[..., :3], alpha.astype(np.uint8)))


def png(img: np.ndarray) -> bytes:
    """A lossless PNG, 8 bits RGBA."""
    chunk = lambda kind, b: struct.pack(">I", len(b)) + kind + b + struct.pack(">I", zlib.crc32(kind + b))
    rows = np.concatenate((np.zeros((img.shape[0], 1), np.uint8), img.reshape(img.shape[0], -1)), axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", img.shape[1], img.shape[0], 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def map_images(images: DataFrame, f, encode: str | None = None) -> DataFrame:
    """f on each image (columns key, width, height, rgba); encode adds a column png or webp. A row whose bytes don't match its size gets an error."""
    encoder = {None: None, "png": png, "webp": webp}[encode]
    schema = "key string, width int, height int, rgba binary, error string" + (f", {encode} binary" if encode else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            rows = []
            for key, w, h, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if raw is None or not w or not h or len(raw) != 4 * w * h:
                    rows.append((key, w, h, None, "no image of this size", None))
                    continue
                out = np.ascontiguousarray(f(np.frombuffer(raw, np.uint8).reshape(h, w, 4)))
                rows.append((key, out.shape[1], out.shape[0], out.tobytes(), None, encoder(out) if encoder else None))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(zip(*rows, strict=True), kinds, names, strict=False)], names=names)

    cols = [images["key"].cast("string"), images["width"].cast("int"), images["height"].cast("int"), images["rgba"]]
    return images.select(*cols).mapInArrow(run, schema)
