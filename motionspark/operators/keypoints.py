"""Camera shifts by features: corners with binary descriptors, matched and put to the vote as rows.

A raster gives its corners, the strongest of each tile, and 256 comparisons of brightness about each. Corners are dealt by clip; a
picture's meet its still's where a band of their bits is the same, and stay if each is the other's nearest. From there on all is joins and windows: pairs of matches
propose motions (turn, scale and shift) that all matches of the picture vote on; the winner's voters fit the motion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import dealt, written
from . import pixels, series, shapes

#: Least corners and matches of a picture, and how far a voter may lie off (pixels).
LEAST, OFF = 12, 3.0
#: Corners of a tile, pixels across a tile, reach of a descriptor, bands of a descriptor, proposals of a picture.
PER_TILE, CORNER_TILE, REACH, BANDS, PROPOSALS = 4, 24, 12, 16, 48
#: Candidates that a picture compares at a time.
PAIRS = 1 << 20
CORNERS = "clip_id long, frame int, corner int, x double, y double, d0 long, d1 long, d2 long, d3 long"
MET = "clip_id long, frame int, a int, b int, x double, y double, u double, v double"

_near = np.clip(np.round(np.random.default_rng(3).normal(0, REACH / 2.5, (256, 4))), -REACH, REACH).astype(int)


def corners(image: np.ndarray, per_tile: int = PER_TILE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, descriptors of 4 longs) of a grey raster's corners: peaks of how much brightness varies both ways, between pixels."""
    if min(image.shape) <= 2 * REACH + 4:
        return np.zeros(0), np.zeros(0), np.zeros((0, 4), np.int64)
    smooth = shapes.blurred(image, 1.2, 3)
    gy, gx = np.gradient(smooth)
    xx, yy, xy = (shapes.blurred(a, 1.5, 4) for a in (gx * gx, gy * gy, gx * gy))
    power = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
    inner = np.s_[1:-1, 1:-1]
    top = np.max([power[1 + b : power.shape[0] - 1 + b, 1 + a : power.shape[1] - 1 + a] for a in (-1, 0, 1) for b in (-1, 0, 1)], axis=0)
    peak = np.zeros(image.shape, bool)
    peak[inner] = (power[inner] == top) & (power[inner] > 1.0)
    peak[: REACH + 1] = peak[-REACH - 1 :] = peak[:, : REACH + 1] = peak[:, -REACH - 1 :] = False
    y, x = np.nonzero(peak)
    tile = (y // CORNER_TILE) * (image.shape[1] // CORNER_TILE + 1) + x // CORNER_TILE
    order = np.lexsort((-power[y, x], tile))
    rank = np.arange(len(order)) - np.maximum.accumulate(np.where(np.append(True, np.diff(tile[order]) != 0), np.arange(len(order)), 0)) if len(order) else order
    chosen = np.sort(order[rank < per_tile])
    y, x = y[chosen], x[chosen]
    bits = smooth[y[:, None] + _near[:, 1], x[:, None] + _near[:, 0]] < smooth[y[:, None] + _near[:, 3], x[:, None] + _near[:, 2]]
    words = np.packbits(bits, axis=1).view(">i8").astype(np.int64).reshape(-1, 4)

    def nudge(low: np.ndarray, mid: np.ndarray, high: np.ndarray) -> np.ndarray:
        bend = 2 * mid - low - high
        return np.clip((high - low) / (2 * np.where(bend > 0, bend, np.inf)), -0.5, 0.5)

    return x + nudge(power[y, x - 1], power[y, x], power[y, x + 1]), y + nudge(power[y - 1, x], power[y, x], power[y + 1, x]), words


def corner_rows(rasters: DataFrame, per_tile: int = PER_TILE, marked: bool = False) -> DataFrame:
    """Rows of CORNERS: at most ``per_tile`` corners for each tile of a raster; if ``marked``, with a row of corner -1 for each raster, be there corners or not."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                x, y, words = corners(shapes.grey(np.frombuffer(r.rgba, np.uint8).reshape(r.h, r.w, 4)), per_tile)
                number = np.arange(len(x), dtype=np.int32)
                if marked:
                    number, x, y, words = np.append(-1, number), np.append(0.0, x), np.append(0.0, y), np.concatenate([np.zeros((1, 4), np.int64), words])
                if len(x):
                    yield pd.DataFrame({"clip_id": r.clip_id, "frame": r.frame, "corner": number, "x": x, "y": y} | {f"d{i}": words[:, i] for i in range(4)})

    return rasters.select("clip_id", "frame", "w", "h", "rgba").mapInPandas(run, CORNERS)


def _bands(words: np.ndarray) -> np.ndarray:
    """(band, bits) as one number of each run of 16 bits, a row a corner."""
    return np.arange(BANDS, dtype=np.int64) << 16 | np.ascontiguousarray(words).view(np.uint16)


def mutual(still: np.ndarray, frame: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners of a still and of a frame, by their descriptors, that are each other's nearest of those that share a band; of equals the first.

    The still's bands are sorted and the frame's looked up in them, PAIRS candidates at a time.
    """
    index = _bands(still).ravel()
    order = np.argsort(index, kind="stable")
    index, owner = index[order], order // BANDS
    asked = _bands(frame)
    low, many = np.searchsorted(index, asked), np.searchsorted(index, asked, "right")
    many -= low
    part = np.cumsum(many.sum(axis=1)) // PAIRS
    near_b, near_a = np.full(len(frame), -1), np.full(len(still), -1)
    least = np.full(len(still), 64 * still.shape[1] + 1)
    for block in np.split(np.arange(len(frame)), np.flatnonzero(np.diff(part)) + 1):
        n = many[block].ravel()
        b = np.repeat(np.repeat(block, BANDS), n)
        a = owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[block].ravel(), n)]
        differ = np.bitwise_count((still[a] ^ frame[b]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        first = lambda key, *then: (o := np.lexsort((*then, key)))[np.append(True, np.diff(key[o]) != 0)] if len(key) else np.zeros(0, int)
        best = first(b, a, differ)
        near_b[b[best]] = a[best]
        best = first(a, b, differ)
        best = best[differ[best] < least[a[best]]]  # an earlier block's is the first of equals
        near_a[a[best]], least[a[best]] = b[best], differ[best]
    b = np.flatnonzero(near_b >= 0)
    b = b[near_a[near_b[b]] == b]
    return near_b[b], b


def matches(stills: DataFrame, frames: DataFrame) -> DataFrame:
    """clip_id, frame, n, x, y, u, v: corners of a clip's still (x, y) and of its frames (u, v) that are each other's nearest by differing bits, numbered by a hash.

    Corners meet only where sixteen neighbouring bits are the same, which one in sixty-five thousand are by chance. They are dealt by clip, each once, and
    meet within a picture, so neither bands nor candidates are rows. A marked frame has a row with no n, whatever else it has.
    """
    together = stills.withColumn("side", F.lit(0)).unionByName(frames.withColumn("side", F.lit(1)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        clip, still = None, None
        for rows in pixels.grouped(batches, ["clip_id", "side", "frame"]):
            of, words = rows["clip_id"].iloc[0], rows[["d0", "d1", "d2", "d3"]].to_numpy()
            if rows["side"].iloc[0] == 0:
                clip, still = of, (rows, words)
                continue
            corner = rows["corner"].to_numpy()
            some = np.flatnonzero(corner >= 0)
            a, b = mutual(still[1], words[some]) if clip == of and len(some) else (np.zeros(0, int), np.zeros(0, int))
            at = np.concatenate([np.flatnonzero(corner < 0), some[b]])
            of_still = {c: np.concatenate([np.full(len(at) - len(a), v), still[0][n].to_numpy()[a] if len(a) else []]) for c, n, v in (("a", "corner", -1), ("x", "x", 0.0), ("y", "y", 0.0))}
            if len(at):
                yield pd.DataFrame({"clip_id": of, "frame": rows["frame"].iloc[0], "a": of_still["a"].astype(np.int32), "b": corner[at], "x": of_still["x"], "y": of_still["y"], "u": rows["x"].to_numpy()[at], "v": rows["y"].to_numpy()[at]})

    met = together.repartition("clip_id").sortWithinPartitions("clip_id", "side", "frame", "corner").mapInPandas(run, MET)
    number = F.row_number().over(Window.partitionBy("clip_id", "frame").orderBy(F.col("a") < 0, F.xxhash64("a", "b"), "a", "b")) - 1
    return met.select("clip_id", "frame", F.when(F.col("a") >= 0, number).alias("n"), "x", "y", "u", "v")


def motions(found: DataFrame) -> DataFrame:
    """clip_id, frame, turn_x, turn_y, sx, sy, votes: each picture's motion (x + iy to (turn_x + i turn_y)(x + iy) + sx + i sy) that most matches follow.

    PROPOSALS pairs of a picture's matches, by their hashed order, each give a motion; every match within OFF pixels of what it says is
    a vote. The first of the proposals with most votes wins, and its voters' least squares are the motion. Pictures with under LEAST
    matches have no row.
    """
    picture = ["clip_id", "frame"]
    many = found.groupBy(*picture).agg(F.count(F.lit(1)).alias("many")).where(F.col("many") >= LEAST)
    pick = many.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(PROPOSALS - 1))))
    first = F.pmod(F.xxhash64("k", F.lit(1)), F.col("many"))
    pick = pick.withColumns({"i": first, "j": F.pmod(first + 1 + F.pmod(F.xxhash64("k", F.lit(2)), F.col("many") - 1), F.col("many"))})
    side = lambda n, s: found.select(*picture, F.col("n").cast("long").alias(n), *[F.col(c).alias(c + s) for c in "xyuv"])
    pairs = pick.join(dealt(side("i", "1")), [*picture, "i"]).join(dealt(side("j", "2")), [*picture, "j"])
    d = {c: F.col(c + "2") - F.col(c + "1") for c in "xyuv"}
    square = d["x"] * d["x"] + d["y"] * d["y"]
    p, q = (d["u"] * d["x"] + d["v"] * d["y"]) / square, (d["v"] * d["x"] - d["u"] * d["y"]) / square
    proposed = pairs.where(square > OFF * OFF).withColumns({"p": p, "q": q})
    proposed = proposed.select(*picture, "k", "p", "q", (F.col("u1") - F.col("p") * F.col("x1") + F.col("q") * F.col("y1")).alias("s"), (F.col("v1") - F.col("q") * F.col("x1") - F.col("p") * F.col("y1")).alias("t"))
    listed = proposed.groupBy(*picture).agg(F.sort_array(F.collect_list(F.struct("k", "p", "q", "s", "t"))).alias("proposals"))  # PROPOSALS of them at most
    voted = found.join(dealt(listed), picture).select(*picture, "x", "y", "u", "v", F.explode("proposals").alias("m"))
    miss = F.sqrt(F.pow(F.col("m.p") * F.col("x") - F.col("m.q") * F.col("y") + F.col("m.s") - F.col("u"), 2.0) + F.pow(F.col("m.q") * F.col("x") + F.col("m.p") * F.col("y") + F.col("m.t") - F.col("v"), 2.0))
    x, y, u, v = (F.col(c) for c in "xyuv")
    sums = {"sx": x, "sy": y, "su": u, "sv": v, "sxx": x * x + y * y, "sxu": x * u + y * v, "sxv": x * v - y * u}
    counted = voted.where(miss <= OFF).groupBy(*picture, "m.k").agg(F.count(F.lit(1)).alias("votes"), *[F.sum(c).alias(n) for n, c in sums.items()])
    won = series.top_k(counted, picture, [F.desc("votes"), F.asc("k")], 1)
    n = F.col("votes")
    spread = F.col("sxx") - (F.col("sx") ** 2 + F.col("sy") ** 2) / n
    fit = won.where((n >= 2) & (spread > 0)).withColumns({"turn_x": (F.col("sxu") - (F.col("sx") * F.col("su") + F.col("sy") * F.col("sv")) / n) / spread, "turn_y": (F.col("sxv") - (F.col("sx") * F.col("sv") - F.col("sy") * F.col("su")) / n) / spread})
    shift_x = (F.col("su") - F.col("turn_x") * F.col("sx") + F.col("turn_y") * F.col("sy")) / n
    shift_y = (F.col("sv") - F.col("turn_y") * F.col("sx") - F.col("turn_x") * F.col("sy")) / n
    return fit.select(*picture, "turn_x", "turn_y", shift_x.alias("sx"), shift_y.alias("sy"), "votes")


def feature_shifts(rasters: DataFrame, stills: DataFrame | None = None) -> DataFrame:
    """clip_id, frame, sx, sy: how far the camera has moved against the clip's still, by what most of the picture does.

    Where too few corners match, the last shift holds, at first 0. Something that moves by itself has its own motion and is outvoted while most of
    the matched corners are the ground's.
    """
    still = (pixels.stills(rasters) if stills is None else stills).withColumn("frame", F.lit(0))
    seen = written(matches(corner_rows(still), corner_rows(rasters, marked=True)), "matches")  # read by each step of the vote
    moved = motions(seen.where("n is not null"))
    every = seen.where("n is null").select("clip_id", "frame").join(dealt(moved.select("clip_id", "frame", F.col("sx").alias("_x"), F.col("sy").alias("_y"))), ["clip_id", "frame"], "left")
    held = series.carry_last(series.carry_last(every, ["clip_id"], "frame", F.col("_x"), "sx"), ["clip_id"], "frame", F.col("_y"), "sy")
    return held.select("clip_id", "frame", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("sx", "sy")])
