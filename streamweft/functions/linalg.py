"""Small vectors and matrices as tuples of columns; everything stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, ...]
Mat = tuple[Vec, ...]


def vec(*names: str) -> Vec:
    return tuple(F.col(n) for n in names)


def mat(prefix: str = "j", size: int = 3) -> Mat:
    return tuple(tuple(F.col(f"{prefix}{r}{c}") for c in range(size)) for r in range(size))


def total(terms: list[Column]) -> Column:
    out = terms[0]
    for x in terms[1:]:
        out = out + x
    return out


def dot(a: Vec, b: Vec) -> Column:
    return total([x * y for x, y in zip(a, b, strict=True)])


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a: Vec, s: Column | float) -> Vec:
    return tuple(x * s for x in a)


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec) -> Vec:
    """A zero vector stays zero."""
    n = norm(a)
    return tuple(F.when(n == 0, x).otherwise(x / n) for x in a)


def same(a: Vec, b: Vec, tolerance: float = 1e-6) -> Column:
    """Equality within ``tolerance`` in each component; 0 asks for exact equality."""
    parts = [(x == y) if tolerance == 0 else (F.abs(x - y) < tolerance) for x, y in zip(a, b, strict=True)]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def matvec(m: Mat, a: Vec) -> Vec:
    return tuple(dot(row, a) for row in m)


def vecmat(a: Vec, m: Mat) -> Vec:
    return tuple(total([a[r] * m[r][c] for r in range(len(a))]) for c in range(len(m[0])))


def matmul(a: Mat, b: Mat) -> Mat:
    return tuple(tuple(total([a[r][k] * b[k][c] for k in range(len(b))]) for c in range(len(b[0]))) for r in range(len(a)))


def matadd(a: Mat, b: Mat) -> Mat:
    return tuple(add(x, y) for x, y in zip(a, b, strict=True))


def matsub(a: Mat, b: Mat) -> Mat:
    return tuple(sub(x, y) for x, y in zip(a, b, strict=True))


def matscale(a: Mat, s: Column | float) -> Mat:
    return tuple(scale(r, s) for r in a)


def transpose(m: Mat) -> Mat:
    return tuple(zip(*m, strict=True))


def trace(m: Mat) -> Column:
    return total([m[i][i] for i in range(len(m))])


def det3(m: Mat) -> Column:
    return dot(m[0], cross(m[1], m[2]))


def inv3(m: Mat) -> Mat:
    """Inverse; all zeros where the matrix is singular."""
    d = det3(m)
    columns = (cross(m[1], m[2]), cross(m[2], m[0]), cross(m[0], m[1]))
    return tuple(tuple(F.when(d == 0, F.lit(0.0)).otherwise(columns[c][r] / d) for c in range(3)) for r in range(3))


def det4(m: Mat) -> Column:
    parts = []
    for c in range(4):
        minor = tuple(tuple(m[r][k] for k in range(4) if k != c) for r in range(1, 4))
        parts.append(m[0][c] * det3(minor) * (1.0 if c % 2 == 0 else -1.0))
    return total(parts)


def inv4(m: Mat) -> Mat:
    """Inverse by cofactors; all zeros where the matrix is singular."""
    d = det4(m)

    def cofactor(r: int, c: int) -> Column:
        minor = tuple(tuple(m[a][b] for b in range(4) if b != c) for a in range(4) if a != r)
        return det3(minor) * (1.0 if (r + c) % 2 == 0 else -1.0)

    return tuple(tuple(F.when(d == 0, F.lit(0.0)).otherwise(cofactor(c, r) / d) for c in range(4)) for r in range(4))


def identity(size: int = 3) -> Mat:
    return tuple(tuple(F.lit(float(r == c)) for c in range(size)) for r in range(size))


def rotation(axis: str, degrees: float) -> Mat:
    """4x4 rotation about a coordinate axis."""
    a = F.radians(F.lit(float(degrees)))
    c, s = F.cos(a), F.sin(a)
    m = [list(r) for r in identity(4)]
    p, q = {"x": (1, 2), "y": (2, 0), "z": (0, 1)}[axis]
    m[p][p], m[p][q], m[q][p], m[q][q] = c, -s, s, c
    return tuple(map(tuple, m))


def translation(x: float, y: float, z: float) -> Mat:
    m = [list(r) for r in identity(4)]
    for r, v in enumerate((x, y, z)):
        m[r][3] = F.lit(float(v))
    return tuple(map(tuple, m))


def scaling(x: float, y: float, z: float) -> Mat:
    m = [list(r) for r in identity(4)]
    for r, v in enumerate((x, y, z)):
        m[r][r] = F.lit(float(v))
    return tuple(map(tuple, m))


def symmetric_eigenvalues(m: Mat) -> Vec:
    """Eigenvalues of a symmetric matrix, largest first, by the trigonometric form of the cubic."""
    q = trace(m) / 3.0
    off = m[0][1] * m[0][1] + m[0][2] * m[0][2] + m[1][2] * m[1][2]
    p2 = total([(m[i][i] - q) * (m[i][i] - q) for i in range(3)]) + 2.0 * off
    p = F.sqrt(p2 / 6.0)
    shifted = tuple(tuple((m[r][c] - q) if r == c else m[r][c] for c in range(3)) for r in range(3))
    half = F.when(p == 0, F.lit(0.0)).otherwise(det3(shifted) / (2.0 * p * p * p))
    phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3.0
    first = q + 2.0 * p * F.cos(phi)
    last = q + 2.0 * p * F.cos(phi + 2.0943951023931953)
    return (first, 3.0 * q - first - last, last)
