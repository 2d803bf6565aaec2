"""Scalar, vector and small-matrix column functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dwitable.functions.columns import ColumnLike, col

Vec = Sequence[ColumnLike]

GIMBAL_TOLERANCE = 1e-9


def dot3(a: Vec, b: Vec) -> Column:
    """Scalar product of two 3-vectors."""
    return col(a[0]) * col(b[0]) + col(a[1]) * col(b[1]) + col(a[2]) * col(b[2])


def cross3(a: Vec, b: Vec) -> tuple[Column, Column, Column]:
    """Vector product of two 3-vectors."""
    (ax, ay, az), (bx, by, bz) = map(col, a), map(col, b)
    return ay * bz - az * by, az * bx - ax * bz, ax * by - ay * bx


def norm3(a: Vec) -> Column:
    """Length of a 3-vector."""
    return F.sqrt(dot3(a, a))


def unit3(a: Vec) -> tuple[Column, Column, Column]:
    """A 3-vector divided by its length; NULL for the zero vector."""
    n = norm3(a)
    return tuple(F.try_divide(col(c), n) for c in a)


def row_times_affine(vec: Vec, affine: Sequence[Sequence[ColumnLike]]) -> tuple[Column, Column, Column]:
    """First three entries of ``[x, y, z, 1] . A`` (a row vector times the matrix, not normalised again)."""
    x, y, z = map(col, vec)
    return tuple(
        x * col(affine[0][j]) + y * col(affine[1][j]) + z * col(affine[2][j]) + col(affine[3][j]) for j in range(3)
    )


def affine_times_point(affine: Sequence[Sequence[ColumnLike]], point: Vec) -> tuple[Column, Column, Column]:
    """First three entries of ``A . (x, y, z, 1)``."""
    x, y, z = map(col, point)
    return tuple(
        col(affine[r][0]) * x + col(affine[r][1]) * y + col(affine[r][2]) * z + col(affine[r][3]) for r in range(3)
    )


def affine_columns(prefix: str = "a") -> list[list[str]]:
    """Names of the sixteen columns of a 4x4 matrix, row by row."""
    return [[f"{prefix}{r}{c}" for c in range(4)] for r in range(4)]


def _clamp(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0))


def rotation_angles(a: Sequence[Sequence[ColumnLike]]) -> tuple[Column, Column, Column]:
    """Euler angles ``(rx, ry, rz)`` of the rotation part of a matrix.

    ``R[0][2] = sin(ry)``. At ``|ry| = pi/2`` the first and last rotations share an axis; the whole turn then
    goes to ``rz`` and ``rx`` is zero.
    """
    m = [[col(c) for c in row] for row in a]
    ry = F.asin(m[0][2])
    c = F.cos(ry)

    def ratio(num: Column, den: Column) -> Column:
        return _clamp(F.try_divide(num, den))

    locked = F.pow(F.abs(ry) - F.pi() / 2, F.lit(2)) < GIMBAL_TOLERANCE
    rx = F.when(locked, F.lit(0.0)).otherwise(F.atan2(ratio(m[1][2], c), ratio(m[2][2], c)))
    rz = F.when(locked, F.atan2(-_clamp(m[1][0]), ratio(-m[2][0], m[0][2]))).otherwise(
        F.atan2(ratio(m[0][1], c), ratio(m[0][0], c))
    )
    return rx, ry, rz


def nearest_square(n: ColumnLike) -> Column:
    """The smallest integer whose square is at least ``n``."""
    return F.ceil(F.sqrt(col(n).cast("double"))).cast("int")


def scale_z(z: ColumnLike) -> Column:
    """A z-score on the 0..100 scale that maps -3 to 0 and 3 to 100, not clamped."""
    return (col(z) + 3) / 6 * 100


def significant(x: ColumnLike, digits: int = 3) -> Column:
    """A number rounded to a count of significant digits."""
    v = col(x)
    magnitude = F.pow(F.lit(10.0), F.lit(digits - 1) - F.floor(F.log10(F.abs(v))))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.round(v * magnitude) / magnitude)


def z_colour(z: ColumnLike, high_is_good: ColumnLike | bool) -> Column:
    """Colour class of a z-score: beyond one deviation it is good or bad by direction."""
    z = col(z)
    good_high = F.lit(high_is_good) if isinstance(high_is_good, bool) else col(high_is_good)
    return (
        F.when(z <= -1, F.when(good_high, F.lit("danger")).otherwise(F.lit("success")))
        .when(z >= 1, F.when(good_high, F.lit("success")).otherwise(F.lit("danger")))
        .otherwise(F.lit("primary"))
    )


def matmul(a: ColumnLike, b: ColumnLike) -> Column:
    """Product of two matrices held as arrays of rows."""
    a, b = col(a), col(b)
    n = F.size(F.element_at(b, 1))

    def entry(row: Column, j: Column) -> Column:
        products = F.zip_with(row, b, lambda x, brow: x * F.element_at(brow, j))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    return F.transform(a, lambda row: F.transform(F.sequence(F.lit(1), n), lambda j: entry(row, j)))


def sym3_eigenvalues(
    xx: ColumnLike, yy: ColumnLike, zz: ColumnLike, xy: ColumnLike, xz: ColumnLike, yz: ColumnLike
) -> tuple[Column, Column, Column]:
    """Eigenvalues of a symmetric 3x3 matrix, largest first, by the trigonometric formula."""
    xx, yy, zz, xy, xz, yz = map(col, (xx, yy, zz, xy, xz, yz))
    q = (xx + yy + zz) / 3
    off = xy * xy + xz * xz + yz * yz
    p = F.sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * off) / 6)
    det = (
        (xx - q) * ((yy - q) * (zz - q) - yz * yz)
        - xy * (xy * (zz - q) - yz * xz)
        + xz * (xy * yz - (yy - q) * xz)
    )
    r = _clamp(F.coalesce(F.try_divide(det, 2 * p * p * p), F.lit(1.0)))
    phi = F.acos(r) / 3
    e1 = q + 2 * p * F.cos(phi)
    e3 = q + 2 * p * F.cos(phi + 2 * F.pi() / 3)
    return e1, 3 * q - e1 - e3, e3


def major_eigenvector(
    e1: ColumnLike, e2: ColumnLike, e3: ColumnLike,
    xx: ColumnLike, yy: ColumnLike, zz: ColumnLike, xy: ColumnLike, xz: ColumnLike, yz: ColumnLike,
) -> tuple[Column, Column, Column]:
    """Absolute direction of the largest eigenvalue: the longest column of ``(D - e2)(D - e3)``.

    Every column of that product is a multiple of the wanted eigenvector, so the longest is taken. Where the
    largest eigenvalue is not unique the direction is not defined and the result is NULL.
    """
    e1, e2, e3, xx, yy, zz, xy, xz, yz = map(col, (e1, e2, e3, xx, yy, zz, xy, xz, yz))
    d = [[xx, xy, xz], [xy, yy, yz], [xz, yz, zz]]

    def shifted(e: Column) -> list[list[Column]]:
        return [[d[r][c] - e if r == c else d[r][c] for c in range(3)] for r in range(3)]

    left, right = shifted(e2), shifted(e3)
    columns = [[sum(left[r][m] * right[m][c] for m in range(3)) for r in range(3)] for c in range(3)]
    candidates = F.array(*[
        F.struct(norm3(v).alias("n"), *[v[r].alias(a) for r, a in enumerate("xyz")]) for v in columns
    ])
    best = F.array_max(candidates)
    safe = (e1 - e2) > 1e-9 * F.abs(e1)
    return tuple(F.when(safe, F.abs(F.try_divide(best[a], best["n"]))) for a in "xyz")
