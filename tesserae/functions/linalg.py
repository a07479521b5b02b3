"""Three-dimensional linear algebra as column expressions, which stay within whole-stage code generation.

A vector is a list of 3 columns, a matrix a list of 9, row by row; a 4x4 transform is 16.
"""

from __future__ import annotations

from math import cos, radians, sin

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = list[Column]
Matrix = list[Column]


def deg2rad(d: Column) -> Column:
    return d * F.lit(3.141592653589793) / 180.0


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> Vector:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Vector) -> Vector:
    """A vector without length stays zero."""
    n = norm(a)
    return [F.when(n < 1e-12, 0.0).otherwise(x / F.nullif(n, F.lit(0.0))) for x in a]


def normalise2(x: Column, y: Column) -> Vector:
    """In the plane; without length it is (1, 0)."""
    n = F.sqrt(x * x + y * y)
    return [F.when(n < 1e-12, 1.0).otherwise(x / F.nullif(n, F.lit(0.0))), F.when(n < 1e-12, 0.0).otherwise(y / F.nullif(n, F.lit(0.0)))]


def identity() -> Matrix:
    return [F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)]


def diagonal(x: float, y: float, z: float) -> Matrix:
    return [F.lit((x, y, z)[i // 4] if i % 4 == 0 else 0.0) for i in range(9)]


def rotation(axis: str, degrees: float | Column) -> Matrix:
    if isinstance(degrees, Column):
        c, s = F.cos(deg2rad(degrees)), F.sin(deg2rad(degrees))
    else:
        c, s = F.lit(cos(radians(degrees))), F.lit(sin(radians(degrees)))
    one, zero = F.lit(1.0), F.lit(0.0)
    return {"x": [one, zero, zero, zero, c, -s, zero, s, c], "y": [c, zero, s, zero, one, zero, -s, zero, c], "z": [c, -s, zero, s, c, zero, zero, zero, one]}[axis]


def matmul(a: Matrix, b: Matrix, n: int = 3) -> Matrix:
    return [sum((a[n * i + k] * b[n * k + j] for k in range(1, n)), a[n * i] * b[j]) for i in range(n) for j in range(n)]


def apply(m: Matrix, v: Vector) -> Vector:
    return [dot(m[3 * i : 3 * i + 3], v) for i in range(3)]


def transpose(m: Matrix) -> Matrix:
    return [m[3 * j + i] for i in range(3) for j in range(3)]


def determinant(m: Matrix) -> Column:
    return dot(m[:3], cross(m[3:6], m[6:9]))


def inverse(m: Matrix) -> Matrix:
    """By cofactors; a singular matrix gives the identity."""
    d = determinant(m)
    rows = m[:3], m[3:6], m[6:9]
    cols = [cross(rows[1], rows[2]), cross(rows[2], rows[0]), cross(rows[0], rows[1])]
    return [F.when(F.abs(d) < 1e-12, float(i == j)).otherwise(cols[j][i] / F.nullif(d, F.lit(0.0))) for i in range(3) for j in range(3)]


def quaternion(rx: Column, ry: Column, rz: Column) -> list[Column]:
    """(x, y, z, w) of Euler angles in radians, half angles."""
    (cx, sx), (cy, sy), (cz, sz) = ((F.cos(a * 0.5), F.sin(a * 0.5)) for a in (rx, ry, rz))
    return [sx * cy * cz - cx * sy * sz, cx * sy * cz + sx * cy * sz, cx * cy * sz - sx * sy * cz, cx * cy * cz + sx * sy * sz]


def quaternion_matrix(q: list[Column]) -> Matrix:
    x, y, z, w = q
    return [1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]


def compose(rot: Matrix, t: Vector) -> Matrix:
    """A 4x4 transform of a rotation and a translation."""
    return [*rot[:3], t[0], *rot[3:6], t[1], *rot[6:9], t[2], *(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0))]


def transform_point(m: Matrix, v: Vector) -> Vector:
    return [dot(m[4 * i : 4 * i + 3], v) + m[4 * i + 3] for i in range(3)]


def is_identity(m: Matrix, n: int = 4, slack: float = 1e-8) -> Column:
    out = F.lit(True)
    for i in range(n * n):
        out &= F.abs(m[i] - (1.0 if i % (n + 1) == 0 else 0.0)) < slack
    return out
