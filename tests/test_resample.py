"""Resampling kernels: identities, sums, known cases, and agreement of the kernel with the pixel-table form."""

import struct
import zlib

import numpy as np
from pyspark.sql import functions as F

from tesserae.operators import images
from tesserae.operators import resample as R


def noise(h, w, seed=0):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 4), dtype=np.uint8)


def test_weights_and_identity():
    assert np.allclose(R.weights(37, 9).sum(axis=1), 1) and np.allclose(R.weights(5, 5), np.eye(5))
    img = noise(6, 5)
    img[..., 3] = 255
    assert (R.resize(img, 5, 6) == img).all() and R.downsample(img, 9, 9) is img
    flat = np.full((32, 32, 4), (10, 200, 30, 255), np.uint8)
    assert (R.downsample(flat, 8, 8) == flat[:8, :8]).all()


def test_crop_trim_mirror():
    img = np.zeros((64, 64, 4), np.uint8)
    img[20:30, 10:22] = (255, 0, 0, 255)
    assert R.crop_alpha(img).shape == (10, 12, 4) and R.crop_alpha(np.zeros((4, 4, 4), np.uint8)).shape == (4, 4, 4)
    line = np.zeros((8, 8, 4), np.uint8)
    line[3, 1:6] = 255
    assert R.crop_alpha(line) is line
    out = R.trim(img, 64, 64)
    ys, xs = np.nonzero(out[..., 3] > 127)
    assert xs.max() - xs.min() + 1 in (55, 56, 57) and out.shape == (64, 64, 4)
    full = noise(64, 64)
    full[..., 3] = 255
    assert R.trim(full, 64, 64) is full
    pair = R.crop_alpha(R.mirror_pair(img, 64, 64, 0.7))[..., 3].astype(int)
    assert np.abs(pair[:, ::-1] - pair).max() <= 1 and pair.any()


def test_background():
    img = np.full((7, 7, 4), (200, 200, 200, 255), np.uint8)
    img[0], img[3, 3], img[1, 1] = (0, 0, 0, 255), (0, 0, 0, 255), (0, 0, 0, 255)
    out = R.background_removed(img, 40)
    assert (out[0, :, 3] == 0).all() and out[1, 1, 3] == 0 and out[3, 3, 3] == 255 and out[5, 5, 3] == 255
    corner = np.full((5, 5, 4), (200, 200, 200, 255), np.uint8)
    corner[0, 0], corner[1, 1] = (0, 0, 0, 0), (0, 0, 0, 255)
    assert R.background_removed(corner, 40)[1, 1, 3] == 255  # diagonal touch is none


def test_png():
    img = noise(3, 5)
    raw = R.png(img)
    n = struct.unpack(">I", raw[33:37])[0]
    rows = np.frombuffer(zlib.decompress(raw[41 : 41 + n]), np.uint8).reshape(3, 21)
    assert raw[:8] == b"\x89PNG\r\n\x1a\n" and (rows[:, 1:].reshape(3, 5, 4) == img).all()


def test_kernel_agrees_with_pixel_table(spark):
    img = noise(8, 8, 4)
    img[..., 3] = np.where(img[..., 3] < 120, 0, 255)
    px = spark.createDataFrame([(1, int(x), int(y), int(img[y, x, 3])) for y in range(8) for x in range(8)], "image long, x int, y int, alpha int")
    got = {(r.x, r.y): r.alpha for r in images.crop(px).collect()}
    cropped = R.crop_alpha(img)
    assert got == {(x, y): int(cropped[y, x, 3]) for y in range(cropped.shape[0]) for x in range(cropped.shape[1])}
    df = spark.createDataFrame([("a", 8, 8, bytearray(img.tobytes())), ("bad", 9, 9, bytearray(b"x")), (None, None, None, None)], "key string, width int, height int, rgba binary")
    rows = {r.key: r for r in R.map_images(df, R.crop_alpha, encode="png").collect()}
    assert bytes(rows["a"].rgba) == cropped.tobytes() and rows["a"].png and rows["bad"].error and rows[None].error
    assert images.mirror(images.mirror(px, 8), 8).exceptAll(px).count() == 0 and px.where(F.col("alpha") < 0).count() == 0


def rotated_plainly(img, degrees):
    h, w = img.shape[:2]
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    width, height = int(np.ceil(w * abs(c) + h * abs(s))), int(np.ceil(w * abs(s) + h * abs(c)))
    out = np.zeros((height, width, 4), int)
    for y in range(height):
        for x in range(width):
            px, py = (x - width / 2) * c + (y - height / 2) * s + w / 2, -(x - width / 2) * s + (y - height / 2) * c + h / 2
            i, j = int(np.floor(px)), int(np.floor(py))
            if min(i, j) >= 0 and i + 1 < w and j + 1 < h:
                taps = [(i, j, (1 - px + i) * (1 - py + j)), (i + 1, j, (px - i) * (1 - py + j)), (i, j + 1, (1 - px + i) * (py - j)), (i + 1, j + 1, (px - i) * (py - j))]
                out[y, x] = [int(min(255, max(0, sum(float(img[b, a, k]) * q for a, b, q in taps))) + 0.5) for k in range(4)]
    return out


def test_rotate():
    img = noise(17, 23, 4)
    assert R.rotate(img, 0.4) is img
    for degrees in (-89.0, -45.0, 12.5, 30.0, 90.0, 133.0):
        want, got = rotated_plainly(img, degrees), R.rotate(img, degrees)
        assert got.shape == want.shape and np.abs(got.astype(int) - want).max() <= 1


def bar(degrees, length=60, head=0):
    """A bar through the middle with a wide part at its far end."""
    y, x = np.mgrid[:101, :101] - 50.0
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    along, across = x * c + y * s, y * c - x * s
    on = (np.abs(along) < length / 2) & (np.abs(across) < np.where(along > length / 4, 3 + head, 3))
    return np.where(on[..., None], np.uint8((90, 60, 30, 255)), np.uint8(0)).astype(np.uint8)


def test_standardise():
    for degrees in (-80, -20, 0, 10, 45, 90):
        out = R.standardise(bar(degrees), 96, 96, 45.0, 0.8)
        ys, xs = np.nonzero(out[..., 3] > 127)
        assert out.shape == (96, 96, 4) and abs(abs(R.main_axis(xs, ys)) - 45) < 3 and R.main_axis(xs, ys) * -1 > 0
    for degrees in (20, 200):
        plain, other = (R.standardise(bar(degrees, head=9), 96, 96, 135.0, 0.8, t) for t in (False, True))
        assert not R.wide_end_ahead(plain, -135.0) and R.wide_end_ahead(other, -135.0)
    few = np.zeros((9, 9, 4), np.uint8)
    few[2, 1:7] = 255
    assert R.standardise(few, 20, 20, 45.0, 0.8) is few and not R.wide_end_ahead(few, 45.0)


def test_flip_agrees_with_table_form(spark):
    rows, want = [], {}
    for k, img in enumerate((bar(-45, head=9), bar(135, head=9), bar(-45), noise(9, 7, 2))):
        rows += [(k, int(x), int(y), int(img[y, x, 3])) for y in range(img.shape[0]) for x in range(img.shape[1])]
        want[k] = R.wide_end_ahead(img, -45.0)
    got = images.flip_needed(spark.createDataFrame(rows, "image int, x int, y int, alpha int")).collect()
    assert {r.image: r.flip for r in got} == want and want[0] and not want[1]


def parts_plainly(on):
    seen, out = set(), []
    for start in zip(*np.nonzero(on), strict=True):
        if start in seen:
            continue
        seen.add(start)
        todo, part = [start], []
        while todo:
            y, x = todo.pop()
            part.append((int(y), int(x)))
            for q in ((y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)):
                if 0 <= q[0] < on.shape[0] and 0 <= q[1] < on.shape[1] and on[q] and q not in seen:
                    seen.add(q)
                    todo.append(q)
        out.append(part)
    return out


def test_largest_part():
    for seed, share in ((1, 0.2), (2, 0.35), (3, 0.5), (4, 0.02)):
        img = noise(24, 31, seed)
        img[np.random.default_rng(seed).random((24, 31)) > share] = 0
        img[..., 3] = np.where(img[..., 3] > 0, 255, 0)
        best = max(parts_plainly(img[..., 3] > 0), key=len)
        got = R.largest_part(img)
        assert sorted(best) == sorted(zip(*(v.tolist() for v in np.nonzero(got[..., 3])), strict=True))
    empty = np.zeros((4, 5, 4), np.uint8)
    assert not R.largest_part(empty).any() and not R.mirror_pair(empty, 8, 8, 0.8).any()
