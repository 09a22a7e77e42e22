"""Outlines of blobs as rows of boundary points, and what is measured on them.

Masks are cleaned with round elements and their borders followed one raster at a time; from there on a boundary point is a row.
Areas and lengths are sums over windows of neighbouring points; hulls and least enclosing circles are taken blob by blob.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import pixels

POINTS = "blob int, at int, x int, y int"
#: The eight ways from a pixel, clockwise in a picture whose y grows downwards.
WAYS = ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1))


def grey(rgba: np.ndarray) -> np.ndarray:
    """Brightness in whole numbers, by the usual weights of red, green and blue."""
    return np.round(rgba[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def blurred(image: np.ndarray, sigma: float = 1.5, half: int = 3) -> np.ndarray:
    """A Gaussian blur of 2 half + 1 taps each way; the border is mirrored without repeating its own pixels."""
    taps = np.exp(-0.5 * (np.arange(-half, half + 1) / sigma) ** 2)
    taps /= taps.sum()
    out = image.astype(float)
    for axis in (0, 1):
        wide = np.pad(out, [(half, half) if a == axis else (0, 0) for a in (0, 1)], "reflect" if out.shape[axis] > half else "edge")
        out = sum(t * (wide[i : i + out.shape[0]] if axis == 0 else wide[:, i : i + out.shape[1]]) for i, t in enumerate(taps))
    return out


@functools.lru_cache
def _halves(r: int) -> list[int]:
    """How far a round element of radius r reaches along its rows, from its middle one outwards."""
    return [int(np.round(r * np.sqrt(max(0.0, 1 - (dy / r) ** 2)))) if r else 0 for dy in range(r + 1)]


def dilated(mask: np.ndarray, size: int) -> np.ndarray:
    """A mask grown by a round element of ``size`` (odd) pixels across: running maxima along rows, one width for each row of the element."""
    r = size // 2
    h, w = mask.shape
    sums = np.zeros((h, w + 2 * r + 1), np.int32)  # from r columns before the raster to r behind it
    np.cumsum(mask, axis=1, out=sums[:, r + 1 : r + 1 + w])
    sums[:, r + 1 + w :] = sums[:, r + w : r + w + 1]
    out, near = np.zeros_like(mask), {}
    for dy in range(max(-r, 1 - h), min(r, h - 1) + 1):
        half = _halves(r)[abs(dy)]
        if half not in near:
            near[half] = sums[:, r + half + 1 : r + half + 1 + w] > sums[:, r - half : r - half + w]
        out[max(0, dy) : h + min(0, dy)] |= near[half][max(0, -dy) : h - max(0, dy)]
    return out


def eroded(mask: np.ndarray, size: int) -> np.ndarray:
    return ~dilated(~mask, size)


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    return dilated(eroded(mask, size), size)


def closed(mask: np.ndarray, size: int) -> np.ndarray:
    return eroded(dilated(mask, size), size)


#: The ways from a pixel in the order they are tried, by the way that it was come to by.
_TRIED = [[(came + k) % 8 for k in range(1, 9)] for came in range(8)]


def border(ids: np.ndarray, x: int, y: int) -> list[tuple[int, int]]:
    """The outer border of the blob whose first pixel in scan order is (x, y), followed clockwise, each pixel as often as it is passed."""
    wide = ids.shape[1] + 2
    own = np.pad(ids == ids[y, x], 1).tobytes()  # a byte a pixel, none set about the raster
    ways = [dx + wide * dy for dx, dy in WAYS]

    def turn(at: int, came: int) -> int | None:
        """The first way, clockwise from the one behind ``came``, that stays on the blob."""
        for way in _TRIED[came]:
            if own[at + ways[way]]:
                return way
        return None

    start = at = (y + 1) * wide + x + 1
    way = turn(at, 4)  # nothing of the blob lies before its first pixel
    out, first = [at], way
    while way is not None:
        at += ways[way]
        way = turn(at, (way + 4) % 8)
        if at == start and way == first:
            break
        out.append(at)
    return [(at % wide - 1, at // wide - 1) for at in out]


def box(mask: np.ndarray, margin: int = 0) -> tuple[slice, slice]:
    """The rows and columns that hold all set pixels, and ``margin`` more on each side as far as the raster goes; none if none is set."""
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    if not len(rows):
        return slice(0, 0), slice(0, 0)
    return tuple(slice(max(0, int(at[0]) - margin), int(at[-1]) + 1 + margin) for at in (rows, columns))


def outlines(mask: np.ndarray, least: float = 0.0) -> Iterator[tuple[int, list[tuple[int, int]]]]:
    """(label, border) of each blob over corners whose bounding box can hold an outline of area ``least``."""
    inner = box(mask)
    ids = pixels.labels(mask[inner], corners=True)
    y, x = np.nonzero(ids)
    if not len(x):
        return
    k = ids[y, x]
    order = np.argsort(k, kind="stable")
    starts = np.flatnonzero(np.diff(k[order], prepend=0))
    left, right, above = np.minimum.reduceat(x[order], starts), np.maximum.reduceat(x[order], starts), y[order][starts]
    below = y[order][np.append(starts[1:], len(order)) - 1]
    firsts = x[order][starts]
    for i in np.flatnonzero((right - left) * (below - above) >= least).tolist():
        own = ids[above[i] : below[i] + 1, left[i] : right[i] + 1]
        dx, dy = inner[1].start + int(left[i]), inner[0].start + int(above[i])
        yield i + 1, [(u + dx, v + dy) for u, v in border(own, int(firsts[i] - left[i]), 0)]


def outline_rows(rasters: DataFrame, by: str, mask_of: Callable, more: tuple[str, ...] = (), arguments: tuple[str, ...] = ()) -> DataFrame:
    """by and POINTS: the outlines of each raster's blobs. ``mask_of(rgba, *arguments)`` gives the mask and the least area of an outline.

    ``by`` is the DDL of the columns that name a raster.
    """
    names = [c.split()[0] for c in by.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                rgba = np.frombuffer(r.rgba, np.uint8).reshape(r.h, r.w, 4)
                mask, least = mask_of(rgba, *[getattr(r, a) for a in arguments])
                rows = [(*[getattr(r, n) for n in names], label, i, x, y) for label, points in outlines(mask, least) for i, (x, y) in enumerate(points)]
                if rows:
                    yield pd.DataFrame(rows, columns=[*names, "blob", "at", "x", "y"])

    return rasters.select(*dict.fromkeys([*names, "w", "h", "rgba", *arguments, *more])).mapInPandas(run, f"{by}, {POINTS}")


def measures(points: DataFrame, by: list[str]) -> DataFrame:
    """by, area, length: the area within each closed outline and its length, over the middles of its pixels."""
    order = Window.partitionBy(*by).orderBy("at")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    steps = points.withColumns({"_u": after("x"), "_v": after("y")})
    cross = F.col("x") * F.col("_v") - F.col("_u") * F.col("y")
    length = F.sqrt((F.pow(F.col("_u") - F.col("x"), 2) + F.pow(F.col("_v") - F.col("y"), 2)).cast("double"))
    return steps.groupBy(*by).agg((F.abs(F.sum(cross)) / 2).alias("area"), F.sum(length).alias("length"))


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The corners of the convex hull of points, one row each, in order around it."""
    ends: dict = {}  # of all points above each other the ends alone can be corners
    for u, v in zip(x.tolist(), y.tolist()):
        low, high = ends.get(u, (v, v))
        ends[u] = (v if v < low else low, v if v > high else high)
    points = [(u, v) for u in sorted(ends) for v in dict.fromkeys(ends[u])]
    if len(points) < 3:
        return np.array(points, float).reshape(-1, 2)

    def chain(some: list[tuple]) -> list[tuple]:
        out: list[tuple] = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]), float)


def hull_area(corners: np.ndarray) -> float:
    x, y = corners.T
    return float(abs(np.sum(x * np.roll(y, -1) - np.roll(x, -1) * y)) / 2)


def least_circle(corners: np.ndarray) -> tuple[float, float, float]:
    """(x, y, radius) of the least circle about points: the farthest point joins the circle's support until none lies outside.

    The circle of a support of two or three points is the least among those through two or three of them that hold all.
    """
    points = [tuple(p) for p in corners.tolist()]
    far = max(points, key=lambda p: math.hypot(p[0] - points[0][0], p[1] - points[0][1]))
    support, circle = _needed([points[0], far])
    while True:
        x, y, r = circle
        off = [math.hypot(u - x, v - y) for u, v in points]
        most = max(off)
        if most <= r + 1e-9 * (1 + r):
            return circle
        support, circle = _needed([*support, points[off.index(most)]])


def _through(points: Sequence) -> tuple[float, float, float] | None:
    x, y = float(points[0][0]), float(points[0][1])
    if len(points) == 1:
        return x, y, 0.0
    ax, ay = float(points[1][0]) - x, float(points[1][1]) - y
    if len(points) == 2:
        return x + ax / 2, y + ay / 2, math.hypot(ax, ay) / 2
    bx, by = float(points[2][0]) - x, float(points[2][1]) - y
    twice = 2 * (ax * by - ay * bx)
    if abs(twice) < 1e-12:
        return None
    a, b = ax * ax + ay * ay, bx * bx + by * by
    u, v = (by * a - ay * b) / twice, (ax * b - bx * a) / twice
    return x + u, y + v, math.hypot(u, v)


def _subsets(points: list[tuple]) -> Iterator[list[tuple]]:
    for i, p in enumerate(points):
        yield [p]
        for j in range(i):
            yield [p, points[j]]
            yield from ([p, points[j], points[k]] for k in range(j))


def _needed(points: list[tuple]) -> tuple[list[tuple], tuple[float, float, float]]:
    """The one, two or three of a few points whose circle is the least that holds them all, and that circle."""
    able = []
    for some in _subsets(points):
        circle = _through(some)
        if circle and all(math.hypot(u - circle[0], v - circle[1]) <= circle[2] + 1e-9 * (1 + circle[2]) for u, v in points):
            able.append((circle[2], len(some), some, circle))
    return min(able, key=lambda a: a[:2])[2:]


ROUND = "cx double, cy double, radius double, hull_area double, minx int, maxx int, miny int, maxy int"


def rounds(points: DataFrame, by: str) -> DataFrame:
    """by and ROUND: least enclosing circle, area of the convex hull and bounding box of each group of points. ``by`` is DDL."""
    names = [c.split()[0] for c in by.split(", ")]

    def shape(rows: dict[str, np.ndarray]) -> list[tuple]:
        x, y = rows["x"], rows["y"]
        corners = hull(x, y)
        return [(*[rows[n][0] for n in names], *least_circle(corners), hull_area(corners), x.min(), x.max(), y.min(), y.max())]

    return pixels.by_key(points, names, shape, f"{by}, {ROUND}")
