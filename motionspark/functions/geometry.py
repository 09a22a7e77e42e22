"""Plane geometry and angles as Column expressions.

Mat coordinates: x across (right positive), y down the mat, in mm. A path bearing is atan2(dx, dy), a
face angle atan2(dy, dx); a face has no direction, so its angle is folded into (-90, 90].
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

SINGULAR = 1e-12
EDGE = 1e-9


def bearing_deg(dx: Column, dy: Column) -> Column:
    """Direction of travel, 0 straight down the mat."""
    return F.degrees(F.atan2(dx, dy))


def fold_angle(deg: Column) -> Column:
    """An orientation in degrees folded into (-90, 90].

    The remainder is taken twice for every sign, as SQL writes it: where a step is a right angle to the last bit, pmod's
    one remainder of what is positive would round otherwise.
    """
    folded = ((deg + 90.0) % F.lit(180.0) + 180.0) % F.lit(180.0) - 90.0
    return F.when(folded == -90.0, F.lit(90.0)).otherwise(folded)


def face_angle(dx: Column, dy: Column) -> Column:
    """Folded orientation of a face vector."""
    return fold_angle(F.degrees(F.atan2(dy, dx)))


def apply_homography(h: Column, x: Column, y: Column) -> Column:
    """struct(x, y) of a point under a row-major 3 x 3 homography; null where the denominator vanishes."""
    e = lambda i: F.element_at(h, i + 1)
    w = e(6) * x + e(7) * y + e(8)
    w = F.when(F.abs(w) > SINGULAR, w)
    return F.struct(((e(0) * x + e(1) * y + e(2)) / w).alias("x"), ((e(3) * x + e(4) * y + e(5)) / w).alias("y"))


def invert3(m: Column) -> Column:
    """Inverse of a row-major 3 x 3 matrix, null if its determinant is below 1e-12."""
    a, b, c, d, e, f, g, h, i = (F.element_at(m, k + 1) for k in range(9))
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    rows = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    return F.when(F.abs(det) >= SINGULAR, F.array(*[r / det for r in rows]))


def point_in_quad(x: Column, y: Column, quad: Column) -> Column:
    """Whether a point lies in a convex quadrilateral (array of four {x, y}), its edges included."""
    sides = []
    for k in range(4):
        p, q = F.element_at(quad, k + 1), F.element_at(quad, (k + 1) % 4 + 1)
        sides.append((q["x"] - p["x"]) * (y - p["y"]) - (q["y"] - p["y"]) * (x - p["x"]))
    left = [s > EDGE for s in sides]
    right = [s < -EDGE for s in sides]
    some = lambda cs: cs[0] | cs[1] | cs[2] | cs[3]
    return ~(some(left) & some(right))


def solve3(m: list[Column], b: list[Column]) -> list[Column]:
    """The solution of a 3 x 3 system (row-major) by Cramer's rule, nulls if it is singular."""
    det = lambda r: r[0] * (r[4] * r[8] - r[5] * r[7]) - r[1] * (r[3] * r[8] - r[5] * r[6]) + r[2] * (r[3] * r[7] - r[4] * r[6])
    whole = det(m)
    whole = F.when(F.abs(whole) >= SINGULAR, whole)
    return [det([b[i // 3] if i % 3 == k else m[i] for i in range(9)]) / whole for k in range(3)]


@F.pandas_udf(ArrayType(DoubleType()))
def homography(src: pd.Series, dst: pd.Series) -> pd.Series:
    """The homography (row-major, last element 1) of four point pairs, each flattened x, y; null if degenerate."""

    def solve(s, d):
        if s is None or d is None:
            return None
        rows, right = [], []
        for (x, y), (u, v) in zip(np.reshape(s, (4, 2)), np.reshape(d, (4, 2))):
            rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
            right += [u, v]
        a = np.array(rows, float)
        if np.linalg.matrix_rank(a) < 8:
            return None
        return [*np.linalg.solve(a, np.array(right, float)).tolist(), 1.0]

    return pd.Series([solve(s, d) for s, d in zip(src, dst)])
