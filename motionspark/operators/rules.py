"""Rules about clips, candidates and charts as Column expressions and small DataFrame operators."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry
from ..staging import dealt, written
from . import series
from .observations import BALL_MM, HEAD_MM

#: The aspect rule, and the gates on size.
CONVERGES, ASPECT_OFF = 1.15, 1.35
AREA_GATE, SIZE_GATE, HEAD_GATE, EDGE_RMS = (0.3, 2.5), (0.4, 2.5), (0.55, 1.7), 3.0
LINE_PIXELS = 300


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def aspect_warning(corners: list[tuple[Column, Column]], width: Column, length: Column) -> Column:
    """struct(seen, declared, suggest_cm) if four corners look unlike the stated mat although its sides do not converge, else null."""
    side = lambda a, b: F.sqrt(F.pow(corners[a][0] - corners[b][0], 2.0) + F.pow(corners[a][1] - corners[b][1], 2.0))
    near, far, left, right = side(0, 1), side(3, 2), side(0, 3), side(1, 2)
    seen, declared = ((left + right) / 2) / F.nullif((near + far) / 2, F.lit(0.0)), length / F.nullif(width, F.lit(0.0))
    flat = F.greatest(near, far) / F.nullif(F.least(near, far), F.lit(0.0)) <= CONVERGES
    off = F.greatest(seen, declared) / F.nullif(F.least(seen, declared), F.lit(0.0))
    warn = flat & (left > 0) & (right > 0) & (length > 0) & (off > ASPECT_OFF)
    return F.when(warn, F.struct(seen.alias("seen"), declared.alias("declared"), (round_half_up(width * seen) / 10).alias("suggest_cm")))


def calibration(corners: Column, width: Column, length: Column) -> Column:
    """The homography (row-major) from four corners, flattened x, y, to a mat of a width and length; null if degenerate."""
    zero = F.lit(0.0)
    return geometry.homography(corners, F.array(zero, zero, width, zero, width, length, zero, length))


def mode_choice(line_pixels: Column, markers: Column, chosen: Column, mode: Column) -> Column:
    """struct(mode, face): a long line and no choice of the user's own switch to top-down; without markers, to none."""
    switch = (line_pixels > LINE_PIXELS) & ~chosen & (mode != "topdown")
    return F.struct(F.when(switch, "topdown").otherwise(mode).alias("mode"), F.when(switch & ~markers, "markerless").otherwise("markers").alias("face"))


def ball_area(h: Column, x: Column, y: Column) -> Column:
    """Pixels that a ball covers at a place of the picture, by the mat's scale across; 0 where there is none."""
    mm = F.abs(geometry.apply_homography(h, x + 1, y)["x"] - geometry.apply_homography(h, x, y)["x"])
    return F.coalesce(F.when(mm > 0, math.pi / 4 * F.pow(BALL_MM / mm, 2.0)), F.lit(0.0))


def area_gate(h: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """struct(least, most) of a ball's pixels within a box; nulls where the scale is known nowhere."""
    areas = F.filter(F.array(*[ball_area(h, x, y) for x, y in ((x0, y0), (x1, y0), (x0, y1), (x1, y1))]), lambda a: a > 0)
    return F.struct((F.array_min(areas) * AREA_GATE[0]).alias("least"), (F.array_max(areas) * AREA_GATE[1]).alias("most"))


def size_ok(n: Column, usual: Column) -> Column:
    """Whether a blob is about as large as the ball has been; anything goes before that is known."""
    return usual.isNull() | (usual == 0) | ((n > usual * SIZE_GATE[0]) & (n < usual * SIZE_GATE[1]))


def nice_range(x: Column, least: float) -> Column:
    """Aggregate: struct(lo, hi) about the middle of the values, 1.18 times their span or ``least``; -1 to 1 without any."""
    lo, hi = F.min(x), F.max(x)
    half = F.greatest(hi - lo, F.lit(least)) * 1.18 / 2
    return F.struct(F.coalesce((lo + hi) / 2 - half, F.lit(-1.0)).alias("lo"), F.coalesce((lo + hi) / 2 + half, F.lit(1.0)).alias("hi"))


def ticks(lo: Column, hi: Column) -> Column:
    """Whole ticks of a chart whose range is widened by 15 % or 0.6 at either end: struct(lo, hi, step, ticks)."""
    pad = F.greatest(F.lit(0.6), (hi - lo) * 0.15)
    a, b = lo - pad, hi + pad
    step = F.greatest(F.lit(1), round_half_up((b - a) / 5)).cast("long")
    first = F.ceil(a / step) * step
    return F.struct(a.alias("lo"), b.alias("hi"), step.alias("step"), F.when(first <= b, F.sequence(first.cast("long"), F.floor(b).cast("long"), step)).otherwise(F.array().cast("array<long>")).alias("ticks"))


def exaggeration(xlo: Column, xhi: Column, ylo: Column, yhi: Column) -> Column:
    """How much wider than long a stroke's chart of 618 by 280 shows a mm."""
    return ((yhi - ylo + 50) / 280) / (2 * F.greatest(F.lit(30.0), (xhi - xlo) / 2 * 1.35) / 618)


def polyline(fits: DataFrame, by: list[str], points: int = 140) -> DataFrame:
    """by, i, along, across: parabolas (a, b, c between lo and hi) as evenly spaced points."""
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / (points - 1)
    spread = fits.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("along", at)
    return spread.select(*by, "i", "along", ((F.col("c") * F.col("along") + F.col("b")) * F.col("along") + F.col("a")).alias("across"))


def strike_frames(tracks: DataFrame, ball: DataFrame) -> DataFrame:
    """clip_id, strike: the first frame whose ball lies 1.2 of its diameters from where it began, else its last one."""
    own = tracks.join(dealt(ball.select("clip_id", "cand", "d")), ["clip_id", "cand"])
    start = own.groupBy("clip_id").agg(F.min_by(F.struct("x", "y"), "frame").alias("a"))
    away = F.sqrt(F.pow(F.col("x") - F.col("a.x"), 2.0) + F.pow(F.col("y") - F.col("a.y"), 2.0)) > F.col("d") * 1.2
    return own.join(dealt(start), "clip_id").groupBy("clip_id").agg(F.coalesce(F.min(F.when(away, F.col("frame"))), F.max("frame")).alias("strike"))


def choose_head(blobs: DataFrame, by: list[str]) -> DataFrame:
    """The blob (x, y, bw, bh, area, bx, by: the ball, ball_d, mm_per_px) of each picture that is most like a head, by size, place and solidity."""
    want = HEAD_MM / F.col("mm_per_px")
    span, d = F.greatest("bw", "bh"), F.sqrt(F.pow(F.col("x") - F.col("ball_x"), 2.0) + F.pow(F.col("y") - F.col("ball_y"), 2.0))
    gates = (F.col("area") >= F.pow(want * 0.25, 2.0)) & (span >= want * 0.45) & (span <= want * 3.0) & (d >= F.col("ball_d") * 0.9) & (d <= want * 3.5)
    score = F.col("area") / F.greatest(F.lit(1.0), F.col("bw") * F.col("bh")) * 1.6 - F.abs(F.least("bw", "bh") - want * 0.62) / want - d / (want * 3.5) * 0.5
    return series.top_k(blobs.where(gates).withColumn("score", score), by, [F.desc("score"), F.asc("cand_idx")], 1).drop("rank")


def choose_face(cands: DataFrame, by: list[str]) -> DataFrame:
    """Top-down: by, cand_idx, source of each picture's face: the edge of the candidate whose width is nearest to a head's, if it is sharp, else a sticker.

    ``cands``: w, rms (null: no edge), sticker (boolean), mm_per_px.
    """
    want = HEAD_MM / F.col("mm_per_px")
    fits = F.col("w").between(want * HEAD_GATE[0], want * HEAD_GATE[1])
    best = F.min(F.when(fits, F.struct(F.abs(F.col("w") - want).alias("off"), "cand_idx", "rms"))).alias("best")
    g = cands.groupBy(*by).agg(best, F.max("sticker").alias("sticker"))
    sharp = F.coalesce(F.col("best.rms") <= EDGE_RMS, F.lit(False))
    return g.select(*by, F.when(sharp, F.col("best.cand_idx")).alias("cand_idx"), F.when(sharp, "edge").when(F.col("sticker"), "sticker").alias("source"))


def mutual_nearest(left: DataFrame, right: DataFrame, by: list[str], at: str, key: str) -> DataFrame:
    """by, ``key``, other: rows of either side that are each other's nearest on ``at``, the lower of equals first.

    Both sides go through one sorted series in either direction, so no pairs are made but those found.
    """
    other = lambda df: df.select(*by, F.col(at).alias("_at"), F.col(key).alias("other"))
    ahead = series.nearest(left.select(*by, at, key), other(right), by, at, "_at", "other").select(*by, key, F.col("nearest_other").alias("other"))
    back = series.nearest(other(right), left.select(*by, at, key), by, "_at", at, key).select(*by, F.col(f"nearest_{key}").alias(key), "other")
    return ahead.where("other is not null").join(back, [*by, key, "other"])


def connected(links: DataFrame) -> DataFrame:
    """node, root: the least node that the links (a, b) reach from each; labels spread from neighbours and from the label's own label."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        one = labels.join(near, labels["node"] == near["a"]).select("node", "root", F.least("root", "near").alias("new"))
        far = one.select(F.col("node").alias("new"), F.col("new").alias("far"))
        moved = written(one.join(far, "new", "left").select("node", F.col("root").alias("old"), F.least("new", F.coalesce("far", "new")).alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.where("old <> root").isEmpty():
            return labels


def merge_near(points: DataFrame, by: list[str], key: str, x: str, y: str, reach: float) -> DataFrame:
    """by, ``key``, fragment: points within ``reach`` of each other, directly or through others, are one; its least key names it.

    Points meet only in their own and the neighbouring cells of a grid as wide as the reach. Two neighbouring cells meet in one of them alone: a point goes
    to its own cell and to four of the eight about it, the others' points come to its own.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    p = points.select(*by, F.col(key).alias("b"), F.col(x).alias("_x"), F.col(y).alias("_y"), cell(x).alias("_i"), cell(y).alias("_j"))
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))]))
    around = p.withColumn("s", step).select(*by, F.col("b").alias("a"), F.col("_x").alias("_u"), F.col("_y").alias("_v"), (F.col("_i") + F.col("s.i")).alias("_i"), (F.col("_j") + F.col("s.j")).alias("_j"), ((F.col("s.i") == 0) & (F.col("s.j") == 0)).alias("own"))
    near = F.pow(F.col("_x") - F.col("_u"), 2.0) + F.pow(F.col("_y") - F.col("_v"), 2.0) <= reach * reach
    links = p.join(around, [*by, "_i", "_j"]).where((~F.col("own") | (F.col("a") < F.col("b"))) & near)
    found = connected(links).withColumnsRenamed({"node": key, "root": "fragment"})
    return points.select(*by, key).join(found, key, "left").select(*by, key, F.coalesce("fragment", key).alias("fragment"))


def _first_of_each(frames: Iterator[pd.DataFrame], by: list[str], x: str, y: str, reach: float) -> Iterator[pd.DataFrame]:
    key, cells = None, {}
    for rows in frames:
        keep = []
        for i, (of, px, py) in enumerate(zip(zip(*[rows[c] for c in by]), rows[x], rows[y])):
            if of != key:
                key, cells = of, {}
            i0, j0 = math.floor(px / reach), math.floor(py / reach)
            near = (q for a in (-1, 0, 1) for b in (-1, 0, 1) for q in cells.get((i0 + a, j0 + b), ()))
            if all(math.hypot(px - u, py - v) >= reach for u, v in near):
                cells.setdefault((i0, j0), []).append((px, py))
                keep.append(i)
        yield rows.iloc[keep]


def first_of_each(points: DataFrame, by: list[str], order: list[Column], x: str, y: str, reach: float) -> DataFrame:
    """In the given order, the points that lie at least ``reach`` from every point kept before them (of their key).

    What is kept depends on what was kept before, so a key's sorted points stream through one task, which
    holds the kept ones in cells.
    """
    return points.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(partial(_first_of_each, by=by, x=x, y=y, reach=reach), points.schema)


def read_prefs(text: Column, defaults: dict[str, str | float]) -> Column:
    """A JSON object of preferences as a struct; what is missing, or all if the text is no object, has its default."""
    kinds = ", ".join(f"{k} {'string' if isinstance(v, str) else 'double'}" for k, v in defaults.items())
    parsed = F.from_json(text, kinds, {"mode": "PERMISSIVE"})
    return F.struct(*[F.coalesce(parsed[k], F.lit(v)).alias(k) for k, v in defaults.items()])


def iso_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
