"""Pixel operators over rasters (clip_id, frame, w, h, rgba).

Masks and connected components run in numpy, one raster at a time within Arrow batches; what follows on the
blobs (gates, ranking, lines) is relational. A raster is never exploded into rows of pixels except where
the pixels themselves are asked for (``exploded``); medians over frames are taken tile by tile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import dealt
from .series import top_k

BLOBS = "clip_id long, frame int, cand_idx int, x double, y double, n int, weight double, theta double, elongation double, minx int, maxx int, miny int, maxy int"


def hsv(rgba: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees, saturation and value of an h x w x 4 raster."""
    r, g, b = (rgba[..., i].astype(float) / 255 for i in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    d = top - low
    safe = np.where(d > 0, d, 1)
    h = np.select([d == 0, top == r, top == g], [0, ((g - b) / safe) % 6, (b - r) / safe + 2], (r - g) / safe + 4) * 60
    return h, np.where(top > 0, d / np.where(top > 0, top, 1), 0), top


_top, _low = np.meshgrid(np.arange(256) / 255, np.arange(256) / 255, indexing="ij")
SECTORS = ("rgb", "grb", "gbr", "bgr", "brg", "rbg")
#: Saturation and value by a pixel's highest and lowest channel, as ``hsv`` has them.
_SATURATION, _VALUE = np.where(_top > 0, (_top - _low) / np.where(_top > 0, _top, 1), 0), _top


def where(rgba: np.ndarray, keep: Callable[[np.ndarray, np.ndarray], np.ndarray], hue: float | None = None, tol: float = 0.0) -> np.ndarray:
    """The mask of pixels that ``keep(s, v)`` holds for and, if asked for, whose hue is near ``hue``; hues are taken of those pixels only."""
    r, g, b = (np.ascontiguousarray(rgba[..., i]) for i in range(3))
    top, low = np.maximum(np.maximum(r, g), b), np.minimum(np.minimum(r, g), b)
    mask = keep(_SATURATION, _VALUE).ravel()[top.astype(np.int32) << 8 | low]
    if hue is not None:
        channel = {"r": r, "g": g, "b": b}
        near = np.zeros_like(mask)
        for k, (x, y, z) in enumerate(SECTORS):  # of 60 degrees each, by the order of the channels
            if ((60 * k + 30 - hue + 180) % 360 - 180 + 30 + tol) % 360 <= 60 + 2 * tol or tol >= 150:
                near |= (channel[x] >= channel[y]) & (channel[y] >= channel[z])
        mask &= near
        at = np.nonzero(mask)
        mask[at] = hue_near(hsv(rgba[at])[0], hue, tol)
    return mask


def value(rgba: np.ndarray) -> np.ndarray:
    """The value of each pixel: its highest channel, from 0 to 1."""
    return np.maximum(np.maximum(rgba[..., 0], rgba[..., 1]), rgba[..., 2]) / 255


def labels(mask: np.ndarray, corners: bool = False) -> np.ndarray:
    """Connected components of a mask, over edges or over ``corners`` too: 0 outside, 1, 2, ... inside, in scan order.

    A row's runs of set pixels are the nodes and runs that touch in the next row the links. Every run takes the least
    root that its links know until all agree, so work grows with the runs, not with blobs times pixels.
    """
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    step = np.diff(padded.ravel(), append=0)
    starts, ends = np.flatnonzero(step == 1) + 1, np.flatnonzero(step == -1) + 1  # in the padded raster, ends behind the run
    below = starts + w + 2, ends + w + 2  # the stretch in the next row that a run touches
    first = np.searchsorted(ends, below[0], "left" if corners else "right")
    behind = np.searchsorted(starts, below[1], "right" if corners else "left")
    many = np.maximum(behind - first, 0)
    above = np.repeat(np.arange(len(starts)), many)
    under = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
    root = np.arange(len(starts))
    while len(above):
        one, two = root[above], root[under]
        apart = one != two
        if not apart.any():
            break
        above, under, one, two = above[apart], under[apart], one[apart], two[apart]
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))
        while (root[root] != root).any():
            root = root[root]
    number = np.cumsum(root == np.arange(len(root)))[root]
    out = np.zeros(h * (w + 2) + 1, np.int64)
    out[starts] = number
    out[ends] -= number
    return np.cumsum(out)[:-1].reshape(h, w + 2)[:, 1:-1]


def _blobs(mask: np.ndarray, weight: np.ndarray, min_px: int, corners: bool = False) -> dict[str, np.ndarray]:
    """A column for each of ``moments``' values."""
    rows, columns = np.flatnonzero(mask.any(axis=1)), np.flatnonzero(mask.any(axis=0))
    top, left = (int(rows[0]), int(columns[0])) if len(rows) else (0, 0)
    inner = np.s_[top : rows[-1] + 1, left : columns[-1] + 1] if len(rows) else np.s_[:0, :0]  # labelled within the box that holds the mask
    ids = labels(mask[inner], corners)
    y, x = np.nonzero(ids)
    k = ids[y, x] - 1
    y, x = y + top, x + left
    n = np.bincount(k)
    of = lambda v, size=len(n): np.bincount(k, v, size)
    w = weight[y, x].astype(float)
    total = of(w)
    total[total == 0] = 1.0
    cx, cy = of(x * w) / total, of(y * w) / total
    u, v = x - cx[k], y - cy[k]
    xx, yy, xy = of(u * u * w) / total, of(v * v * w) / total, of(u * v * w) / total
    root = np.sqrt((xx - yy) ** 2 + 4 * xy * xy)
    wide, narrow = (xx + yy + root) / 2, np.maximum((xx + yy - root) / 2, 1e-9)
    low, high = np.full((2, len(n)), max(mask.shape)), np.zeros((2, len(n)), int)
    for i, at in enumerate((x, y)):
        np.minimum.at(low[i], k, at)
        np.maximum.at(high[i], k, at)
    found = {"x": cx, "y": cy, "n": n, "weight": total, "theta": 0.5 * np.arctan2(2 * xy, xx - yy), "elongation": np.sqrt(wide / narrow), "minx": low[0], "maxx": high[0], "miny": low[1], "maxy": high[1], "label": np.arange(1, len(n) + 1)}
    able = np.flatnonzero(n >= min_px)
    order = able[np.argsort(-total[able], kind="stable")]
    return {c: v[order] for c, v in found.items()}


def moments(mask: np.ndarray, weight: np.ndarray, min_px: int = 1, corners: bool = False) -> pd.DataFrame:
    """The blobs of ``min_px`` pixels or more, by weight: weighted centroid, direction and elongation by second moments, bounding box, label."""
    return pd.DataFrame(_blobs(mask, weight, min_px, corners))


def components(mask: np.ndarray, weight: np.ndarray, min_px: int, most: int | None = None) -> list[dict]:
    """The blobs of ``moments`` as dictionaries, the ``most`` heaviest if so many are asked for."""
    found = _blobs(mask, weight, min_px)
    return [dict(zip(found, row)) for row in zip(*[v[:most].tolist() for v in found.values()])]


def _whole(frames: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Batches that are sorted by ``names``, cut anew so that each holds all rows of its keys, with the limits of the keys."""
    held = None
    for f in frames:
        f = f if held is None else pd.concat([held, f], ignore_index=True)
        if not len(f):
            continue
        differ = np.zeros(len(f) - 1, bool)
        for n in names:
            codes = pd.factorize(f[n], use_na_sentinel=False)[0]
            differ |= codes[1:] != codes[:-1]
        starts = [0, *(np.flatnonzero(differ) + 1).tolist()]
        yield f, starts
        held = f.iloc[starts[-1] :]
    if held is not None and len(held):
        yield held, [0, len(held)]


def grouped(frames: Iterator[pd.DataFrame], names: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key of batches that are sorted by ``names``; a key's rows may go on in the next batch."""
    for f, limits in _whole(frames, names):
        for a, b in zip(limits, limits[1:]):
            yield f.iloc[a:b]


def _keyed(frames: Iterator[pd.DataFrame], names: list[str]) -> Iterator[dict[str, np.ndarray]]:
    """As ``grouped``, by columns."""
    for f, limits in _whole(frames, names):
        columns = {c: f[c].to_numpy() for c in f.columns}
        for a, b in zip(limits, limits[1:]):
            yield {c: v[a:b] for c, v in columns.items()}


def table(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    """Rows as a frame, made column by column."""
    return pd.DataFrame(dict(zip(names, map(list, zip(*rows)))), columns=names)


def by_key(rows: DataFrame, names: list[str], each: Callable[[dict[str, np.ndarray]], list[tuple]], columns: str, batch: int = 500) -> DataFrame:
    """The rows ``each(columns of a key's rows)`` of each key: as a grouped map, but many small keys share a batch."""
    shown = [c.split()[0] for c in columns.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for rows in _keyed(frames, names):
            out += each(rows)
            if len(out) >= batch:
                yield table(out, shown)
                out = []
        if out:
            yield table(out, shown)

    return rows.repartition(*names).sortWithinPartitions(*names).mapInPandas(run, columns)


def _raster(row) -> np.ndarray:
    return np.frombuffer(row.rgba, np.uint8).reshape(row.h, row.w, 4)


def blobs(rasters: DataFrame, mask: Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray], min_px: int, most: int | None = None) -> DataFrame:
    """Rows of BLOBS: the components of each raster where ``mask(h, s, v)`` holds, weighted by value."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in BLOBS.split(", ")]
        for f in frames:
            rows = []
            for r in f.itertuples():
                h, s, v = hsv(_raster(r))
                rows += [{"clip_id": r.clip_id, "frame": r.frame, "cand_idx": i, **b} for i, b in enumerate(components(mask(h, s, v), v, min_px, most))]
            yield pd.DataFrame(rows, columns=names)

    return rasters.select("clip_id", "frame", "w", "h", "rgba").mapInPandas(run, BLOBS)


def hue_near(h: np.ndarray, hue: float, tol: float) -> np.ndarray:
    d = np.abs(h - hue) % 360
    return np.minimum(d, 360 - d) <= tol


def ball_candidates(rasters: DataFrame, n_min: int = 6, n_max: int = 10**9, min_fill: float = 0.45, v: float = 0.55, s: float = 0.30) -> DataFrame:
    """Bright, unsaturated blobs of ball size that fill their box; those that fail fall through to the next."""
    found = blobs(rasters, lambda _, sat, val: (val >= v) & (sat <= s), 6)
    fill = F.col("n") / ((F.col("maxx") - F.col("minx") + 1) * (F.col("maxy") - F.col("miny") + 1))
    return found.where(F.col("n").between(n_min, n_max)).withColumn("fill", fill).where(F.col("fill") >= min_fill)


def first_candidate(candidates: DataFrame) -> DataFrame:
    return top_k(candidates, ["clip_id", "frame"], [F.asc("cand_idx")], 1).drop("rank")


def markers(rasters: DataFrame, hue: float = 320, tol: float = 30) -> DataFrame:
    """The two heaviest blobs of the marker's hue in each raster."""
    return top_k(blobs(rasters, lambda h, s, v: hue_near(h, hue, tol) & (s >= 0.45) & (v >= 0.25), 4), ["clip_id", "frame"], [F.desc("weight"), F.asc("cand_idx")], 2)


def putter_blob(rasters: DataFrame) -> DataFrame:
    """The first dark, elongated blob of each raster."""
    return first_candidate(blobs(rasters, lambda h, s, v: v <= 0.34, 40).where("elongation >= 1.7"))


def line_in(rgba: np.ndarray, hue: float = 55, tol: float = 22, min_px: int = 60, elongation: float = 6, band: float = 14) -> tuple[float, float, float, int, float] | None:
    """Direction (radians), middle, pixels and rms of a total least squares line through the pixels near the first long blob of the line's hue."""
    mask, v = where(rgba, lambda s, v: (s >= 0.28) & (v >= 0.28), hue, tol), value(rgba)
    seed = next((b for b in components(mask, v, min_px) if b["elongation"] >= elongation), None)
    if seed is None:
        return None
    y, x = np.nonzero(mask)
    near = np.abs((y - seed["y"]) * np.cos(seed["theta"]) - (x - seed["x"]) * np.sin(seed["theta"])) <= band
    theta, cx, cy, rms = _tls(x[near].astype(float), y[near].astype(float))
    return float(theta), float(cx), float(cy), int(near.sum()), rms


LINES = "clip_id long, frame int, theta_deg double, cx double, cy double, n int, rms double"


def _tls(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float, float]:
    cx, cy = x.mean(), y.mean()
    xx, yy, xy = ((x - cx) ** 2).mean(), ((y - cy) ** 2).mean(), ((x - cx) * (y - cy)).mean()
    root = np.sqrt((xx - yy) ** 2 + 4 * xy * xy)
    return 0.5 * np.arctan2(2 * xy, xx - yy), cx, cy, float(np.sqrt(max((xx + yy - root) / 2, 0.0)))


def target_line(rasters: DataFrame, hue: float = 55, tol: float = 22, min_px: int = 60, elongation: float = 6, band: float = 14) -> DataFrame:
    """Rows of LINES: a total least squares line through the pixels near the first long blob of the line's hue."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                if found := line_in(_raster(r), hue, tol, min_px, elongation, band):
                    rows.append((r.clip_id, r.frame, np.degrees(found[0]), *found[1:]))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINES.split(", ")])

    return rasters.select("clip_id", "frame", "w", "h", "rgba").mapInPandas(run, LINES)


def face_edge(heads: DataFrame, v_min: float = 0.62, min_px: int = 40, trim: float = 2.2) -> DataFrame:
    """Rows of LINES: the leading edge of the bright region about each head.

    ``heads``: clip_id, frame, w, h, rgba, hx, hy (a pixel of the head), ux, uy (unit vector towards the
    ball). For each step along the face the pixel farthest towards the ball counts; a line through those is
    refitted without the ones beyond ``trim`` times its rms, three times at most, keeping eight or more.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                mask = hsv(_raster(r))[2] >= v_min
                ids = labels(mask)
                seed = ids[int(r.hy), int(r.hx)] if 0 <= int(r.hy) < r.h and 0 <= int(r.hx) < r.w else 0
                y, x = np.nonzero(ids == seed) if seed else (np.zeros(0), np.zeros(0))
                if len(x) < min_px:
                    continue
                depth, along = (x - r.hx) * r.ux + (y - r.hy) * r.uy, np.round((y - r.hy) * r.ux - (x - r.hx) * r.uy)
                order = np.lexsort((-depth, along))
                first = order[np.append(True, along[order][1:] != along[order][:-1])]
                px, py = x[first].astype(float), y[first].astype(float)
                theta, cx, cy, rms = _tls(px, py)
                for _ in range(3):
                    keep = np.abs((py - cy) * np.cos(theta) - (px - cx) * np.sin(theta)) <= max(trim * rms, 1e-9)
                    if keep.all() or keep.sum() < 8:
                        break
                    px, py = px[keep], py[keep]
                    theta, cx, cy, rms = _tls(px, py)
                rows.append((r.clip_id, r.frame, np.degrees(theta), cx, cy, len(px), rms))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in LINES.split(", ")])

    return heads.select("clip_id", "frame", "w", "h", "rgba", "hx", "hy", "ux", "uy").mapInPandas(run, LINES)


def sample_hue(rasters: DataFrame, r: int = 6) -> DataFrame:
    """clip_id, frame, hue, s, v, n about a pixel (px, py) of each raster: the circular mean weighted by saturation, of pixels that have any."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for row in f.itertuples():
                box = np.s_[max(0, row.py - r) : max(0, row.py + r + 1), max(0, row.px - r) : max(0, row.px + r + 1)]
                h, s, v = hsv(_raster(row)[box])
                h, s, v = h[s >= 0.2], s[s >= 0.2], v[s >= 0.2]
                if len(h):
                    hue = np.degrees(np.arctan2((np.sin(np.radians(h)) * s).sum(), (np.cos(np.radians(h)) * s).sum())) % 360
                    out.append((row.clip_id, row.frame, float(hue), float(s.mean()), float(v.mean()), len(h)))
            yield pd.DataFrame(out, columns=["clip_id", "frame", "hue", "s", "v", "n"])

    return rasters.select("clip_id", "frame", "w", "h", "rgba", "px", "py").mapInPandas(run, "clip_id long, frame int, hue double, s double, v double, n int")


def exploded(rasters: DataFrame) -> DataFrame:
    """clip_id, frame, x, y, r, g, b: one row for each pixel, by built-in expressions."""
    at = F.col("i") * 4 + 1
    byte = lambda k: F.conv(F.hex(F.substring("rgba", at + k, F.lit(1))), 16, 10).cast("int")
    each = rasters.select("clip_id", "frame", "w", "rgba", F.explode(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1)).alias("i"))
    return each.select("clip_id", "frame", (F.col("i") % F.col("w")).cast("int").alias("x"), F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), byte(0).alias("r"), byte(1).alias("g"), byte(2).alias("b"))


def evenly(rasters: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` evenly spaced frames of each clip."""
    w = Window.partitionBy("clip_id")
    numbered = rasters.withColumns({"_i": F.row_number().over(w.orderBy("frame")) - 1, "_n": F.count(F.lit(1)).over(w)})
    step = F.greatest(F.lit(1.0), F.col("_n") / F.lit(float(sample)))
    return numbered.where(F.floor(F.col("_i") / step) != F.floor((F.col("_i") - 1) / step)).drop("_i", "_n")


#: Pixels across a tile, of which 60 frames take 12 MB; a small picture is one tile.
TILE = 256
TILES = "clip_id long, frame int, tx int, ty int, w int, h int, tile binary"


def tiles(rasters: DataFrame, size: int = TILE) -> DataFrame:
    """Rows of TILES: each raster's red, green and blue in squares of ``size`` pixels, those at its edges smaller."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for r in f.itertuples():
                rgb = _raster(r)[..., :3]
                for y in range(0, r.h, size):
                    rows += [(r.clip_id, r.frame, x // size, y // size, r.w, r.h, rgb[y : y + size, x : x + size].tobytes()) for x in range(0, r.w, size)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in TILES.split(", ")])

    return rasters.select("clip_id", "frame", "w", "h", "rgba").mapInPandas(run, TILES)


def still_tiles(rasters: DataFrame, sample: int | None = 60, size: int = TILE) -> DataFrame:
    """clip_id, tx, ty, w, h, tile: the per-pixel median, cut to a whole number, of at most ``sample`` evenly spaced frames, or of all frames if None.

    A tile's frames meet in one group of ``sample`` small squares, so a clip's pixels are spread over its tiles and none is a row of
    its own. Rasters of a clip that differ in size keep apart.
    """

    names = ["clip_id", "tx", "ty", "w", "h"]

    def middle(rows: dict[str, np.ndarray]) -> list[tuple]:
        return [(*[rows[n][0] for n in names], lower_median(np.stack([np.frombuffer(t, np.uint8) for t in rows["tile"]])).tobytes())]

    seen = rasters.select("clip_id", "frame", "w", "h", "rgba")
    return by_key(tiles(seen if sample is None else evenly(seen, sample), size), names, middle, "clip_id long, tx int, ty int, w int, h int, tile binary", STILLS_A_BATCH)


def lower_median(stack: np.ndarray) -> np.ndarray:
    """The medians of columns of bytes, cut to whole numbers; they are sought where a column's values differ."""
    out = stack[0].copy()
    varied = np.flatnonzero((stack[1:] != stack[0]).any(axis=0))
    n = len(stack)
    middle = np.partition(stack[:, varied], [(n - 1) // 2, n // 2], axis=0)
    out[varied] = (middle[(n - 1) // 2].astype(np.uint16) + middle[n // 2]) // 2
    return out


#: Tiles or stills that are handed on together.
STILLS_A_BATCH = 32


def stills(rasters: DataFrame, sample: int | None = 60, size: int = TILE) -> DataFrame:
    """clip_id, w, h, rgba: the tiles of ``still_tiles`` put together as one opaque raster for each clip."""

    def put(rows: dict[str, np.ndarray]) -> list[tuple]:
        w, h = int(rows["w"][0]), int(rows["h"][0])
        image = np.full((h, w, 4), 255, np.uint8)
        for tx, ty, tile in zip(rows["tx"], rows["ty"], rows["tile"]):
            y, x = ty * size, tx * size
            spot = image[y : y + size, x : x + size, :3]
            spot[:] = np.frombuffer(tile, np.uint8).reshape(spot.shape)
        return [(rows["clip_id"][0], w, h, image.tobytes())]

    return by_key(still_tiles(rasters, sample, size), ["clip_id", "w", "h"], put, "clip_id long, w int, h int, rgba binary", STILLS_A_BATCH)


#: Frames that share one copy of their clip's still.
CHUNK = 64


def with_still(rasters: DataFrame, stills: DataFrame, each: Callable, columns: str, more: tuple[str, ...] = (), chunk: int = CHUNK, of_clip: tuple[str, ...] = (), places: DataFrame | None = None) -> DataFrame:
    """Rows that ``each(raster, still, *of_clip)`` yields, an array of four channels for the still, or None if the clip has none.

    Frames are dealt in chunks and a clip's still goes before each of them, so a long clip is many tasks' work and its still is
    copied once a chunk, not once a frame. ``more`` are columns of the rasters that ``each`` reads, ``of_clip`` columns of the stills, which may then lack
    a raster; frames of clips without a row there are left out. ``places`` are clip_id and frame of the rasters, which are read once more where it is not given.
    """
    part = F.floor(F.col("frame") / chunk).cast("int").alias("_chunk")
    blank = lambda df, names: [F.lit(None).cast(df.schema[c].dataType).alias(c) for c in names]
    frames = rasters.select("clip_id", part, "frame", "w", "h", "rgba", *more, *blank(stills, of_clip))
    fronts = (rasters if places is None else places).select("clip_id", part).distinct().join(dealt(stills), "clip_id")
    fronts = fronts.select("clip_id", "_chunk", F.lit(None).cast("int").alias("frame"), *[F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("w", "h")], "rgba", *blank(rasters, more), *of_clip)
    names = [c.split()[0] for c in columns.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, still, own = None, None, ()
        for f in batches:
            out = []
            for r in f.itertuples():
                if (r.clip_id, r.chunk_no) != of:
                    of, still, own = (r.clip_id, r.chunk_no), None, None
                if pd.isna(r.frame):
                    still = None if r.rgba is None else np.frombuffer(r.rgba, np.uint8).reshape(r.h, r.w, 4)
                    own = [getattr(r, c) for c in of_clip]
                elif own or not of_clip:
                    out += each(r, still, *(own or ()))
            if out:
                yield table(out, names)

    together = frames.unionByName(fronts).withColumnRenamed("_chunk", "chunk_no")
    return together.repartition("clip_id", "chunk_no").sortWithinPartitions("clip_id", "chunk_no", F.asc_nulls_first("frame")).mapInPandas(run, columns)


def background(rasters: DataFrame, sample: int = 60) -> DataFrame:
    """clip_id, x, y, r, g, b: the pixels of each clip's still."""
    return exploded(stills(rasters, sample).withColumn("frame", F.lit(0))).drop("frame")


def match_template(image: np.ndarray, patch: np.ndarray) -> tuple[float, int, int]:
    """Best normalized cross-correlation of a grey patch in an image: score, x, y of its corner.

    By sums of levels, of their squares and of their products with the patch, which are exact for whole numbers; a flat window matches nothing.
    """
    image, patch, n = image.astype(float), patch.astype(float), patch.size

    def sums(of: np.ndarray) -> np.ndarray:
        """Over each window, by sums from the corner."""
        c = np.pad(of.cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        h, w = patch.shape
        return c[h:, w:] - c[:-h, w:] - c[h:, :-w] + c[:-h, :-w]

    total, square = sums(image), n * sums(image * image)
    spread, own = square - total * total, n * (patch * patch).sum() - patch.sum() ** 2
    like = n * np.einsum("ijkl,kl->ij", np.lib.stride_tricks.sliding_window_view(image, patch.shape), patch) - total * patch.sum()
    varied = (spread > 1e-9 * square) & (own > 1e-9 * n * (patch * patch).sum())
    score = np.where(varied, like / np.sqrt(np.where(varied, spread * own, 1)), 0)
    y, x = np.unravel_index(int(score.argmax()), score.shape)
    return float(score[y, x]), int(x), int(y)


TEMPLATE_TRACK = "clip_id long, frame int, x double, y double, score double"


def track_template(rasters: DataFrame, seeds: DataFrame, size: int = 9, reach: int = 12, accept: float = 0.55, lost: int = 8, deadband: float = 1.2) -> DataFrame:
    """Rows of TEMPLATE_TRACK: the seed's patch (clip_id, sx, sy in the first frame) followed through a clip.

    A match below ``accept`` coasts on the last velocity, ``lost`` of them in a row end the track, and a
    move within ``deadband`` pixels counts as rest.
    """

    def clip(rows: pd.DataFrame) -> pd.DataFrame:
        rows, out, half = rows.sort_values("frame"), [], size // 2
        patch, missed, vx, vy = None, 0, 0.0, 0.0
        for r in rows.itertuples():
            grey = lambda *box: _raster(r)[box][..., :3].sum(axis=2, dtype=np.int64)  # noqa: B023, E731
            if patch is None:
                x, y = float(r.sx), float(r.sy)
                patch = grey(slice(max(0, int(y) - half), int(y) + half + 1), slice(max(0, int(x) - half), int(x) + half + 1))
                out.append((r.clip_id, r.frame, x, y, 1.0))
                continue
            cx, cy = int(round(x + vx)), int(round(y + vy))
            top, left = max(0, cy - half - reach), max(0, cx - half - reach)
            area = grey(slice(top, cy + half + reach + 1), slice(left, cx + half + reach + 1))
            score, px, py = match_template(area, patch) if min(area.shape) >= size and patch.shape == (size, size) else (0.0, 0, 0)
            if score >= accept:
                nx, ny = left + px + half, top + py + half
                moved = np.hypot(nx - x, ny - y) > deadband
                vx, vy, missed = (nx - x, ny - y, 0) if moved else (0.0, 0.0, 0)
                x, y = (float(nx), float(ny)) if moved else (x, y)
            else:
                missed += 1
                if missed > lost:
                    break
                x, y = x + vx, y + vy
            out.append((r.clip_id, r.frame, x, y, score))
        return pd.DataFrame(out, columns=[c.split()[0] for c in TEMPLATE_TRACK.split(", ")])

    return rasters.join(dealt(seeds), "clip_id").groupBy("clip_id").applyInPandas(clip, TEMPLATE_TRACK)
