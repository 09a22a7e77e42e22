"""Series operators: one row for each sample, keyed by ``by`` and ordered by ``at``.

All windows of an operator share one partitioning and order, so a series is shuffled and sorted once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry, robust
from ..staging import dealt, written


def _over(by: list[str], at: str):
    return Window.partitionBy(*by).orderBy(at)


def rolling_slope(df: DataFrame, by: list[str], at: str, x: str, y: str, half: int = 5) -> DataFrame:
    """Adds ``slope``: an OLS line of y on x over ``half`` rows either side, cut off at the ends; 0 if x does not vary."""
    near = _over(by, at).rowsBetween(-half, half)
    n, sx, sy = F.count(x).over(near), F.sum(x).over(near), F.sum(y).over(near)
    sxx, sxy = F.sum(F.col(x) * F.col(x)).over(near), F.sum(F.col(x) * F.col(y)).over(near)
    den = n * sxx - sx * sx
    return df.withColumn("slope", F.when((n >= 2) & (F.abs(den) >= 1e-12), (n * sxy - sx * sy) / den).otherwise(0.0))


def rolling_median(df: DataFrame, by: list[str], at: str, y: str, half: int = 4) -> DataFrame:
    """Adds ``median``: the interpolated median over ``half`` rows either side, cut off at the ends."""
    return df.withColumn("median", F.percentile(F.col(y), F.lit(0.5)).over(_over(by, at).rowsBetween(-half, half)))


def still_islands(df: DataFrame, by: list[str], at: str, step: Column, limit: float, least: int = 3) -> DataFrame:
    """The first run of at least ``least`` rows whose ``step`` (from the row before) stays at or below ``limit``: by, first, last, rows."""
    order = _over(by, at)
    numbered = df.withColumns({"_i": F.row_number().over(order) - 1, "_step": step})
    island = F.sum(F.when(F.col("_step") > limit, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = numbered.withColumn("_island", island).groupBy(*by, "_island").agg(F.min("_i").alias("first"), F.max("_i").alias("last"), F.count(F.lit(1)).alias("rows"))
    return runs.where(F.col("rows") >= least).groupBy(*by).agg(F.min(F.struct("first", "last", "rows")).alias("run")).select(*by, "run.*")


def take_while_arc(df: DataFrame, by: list[str], at: str, x: str, y: str, window: float) -> DataFrame:
    """Adds ``arc``, the path length so far, and keeps the prefix up to the first row with |y - y0| > window."""
    order = _over(by, at)
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(order), F.col(y) - F.lag(y).over(order)), F.lit(0.0))
    stepped = df.withColumns({"_step": step, "_far": (F.abs(F.col(y) - F.first(y).over(running)) > window).cast("int")})
    return stepped.withColumns({"arc": F.sum("_step").over(running), "_past": F.max("_far").over(running)}).where("_past = 0").drop("_step", "_far", "_past")


def carry_last(df: DataFrame, by: list[str], at: str, y: Column, name: str = "carried") -> DataFrame:
    """Adds the last value of ``y`` that is not null up to and including the row."""
    return df.withColumn(name, F.last(y, ignorenulls=True).over(_over(by, at).rowsBetween(Window.unboundedPreceding, 0)))


def nearest(left: DataFrame, right: DataFrame, by: list[str], left_at: str, right_at: str, value: str) -> DataFrame:
    """As-of nearest join: adds ``value`` of the right row nearest in time, the earlier one of equals.

    The two sides are put in one series, so the work is one sort of each key and grows with its rows, not
    with the product of both sides. Right rows of equal time are ordered by value, the least one first.
    """
    both = left.select(*by, F.col(left_at).alias("_t"), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v")).unionByName(
        right.groupBy(*by, right_at).agg(F.min(value).alias("_v")).select(*by, F.col(right_at).alias("_t"), F.lit(0).alias("_left"), "_v"), allowMissingColumns=True
    )
    known = F.when(F.col("_left") == 0, F.struct("_t", "_v"))
    back = F.last(known, ignorenulls=True).over(Window.partitionBy(*by).orderBy("_t", "_left").rowsBetween(Window.unboundedPreceding, 0))
    ahead = F.first(known, ignorenulls=True).over(Window.partitionBy(*by).orderBy("_t", F.desc("_left")).rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumns({"_back": back, "_ahead": ahead}).where("_left = 1")
    earlier = F.col("_ahead").isNull() | (F.col("_back").isNotNull() & (F.col("_t") - F.col("_back._t") <= F.col("_ahead._t") - F.col("_t")))
    return found.select("_row.*", F.when(earlier, F.col("_back._v")).otherwise(F.col("_ahead._v")).alias(f"nearest_{value}"))


def unwrap(df: DataFrame, by: list[str], at: str, angle: str) -> DataFrame:
    """Adds ``unwrapped``: the folded angles as a continuous series."""
    order = _over(by, at)
    jumped = df.withColumn("_jump", F.col(angle) - F.lag(angle).over(order))
    step = F.when(F.col("_jump") > 90, -1).when(F.col("_jump") < -90, 1).otherwise(0)
    return jumped.withColumn("unwrapped", F.col(angle) + 180 * F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_jump")


def circular_filter(df: DataFrame, by: list[str], at: str, angle: str, half: int = 6, votes: int = 4, limit: float = 12.0) -> DataFrame:
    """Blanks angles (period 180) more than ``limit`` from the circular medoid of the rows about them, if ``votes`` are there."""
    near = F.collect_list(angle).over(_over(by, at).rowsBetween(-half, half))
    voted = df.withColumn("_near", near)
    off = robust.circular_distance(F.col(angle), robust.circular_medoid(F.col("_near")))
    return voted.withColumn(angle, F.when(~((F.size("_near") >= votes) & (off > limit)), F.col(angle))).drop("_near")


def smoothed_normal(df: DataFrame, by: list[str], at: str, angle: str, half: int = 6) -> DataFrame:
    """Adds ``normal``: the circular mean of period 180 over ``half`` rows either side, by doubled angles."""
    near = _over(by, at).rowsBetween(-half, half)
    twice = F.radians(F.col(angle) * 2)
    return df.withColumn("normal", F.degrees(F.atan2(F.avg(F.sin(twice)).over(near), F.avg(F.cos(twice)).over(near))) / 2)


def across_outliers(df: DataFrame, by: list[str], x: str, least: int = 8, floor: float = 45.0, spread: float = 4.0) -> DataFrame:
    """Rows farther from their key's upper median than max(floor, spread * IQR) go, if the key has ``least`` values or more.

    The quartiles are the values at floor(n q). Rows without a value stay.
    """
    at = lambda q: lambda n: F.least(F.floor(n * q), n - 1)
    bounds = order_statistics(df, by, x, {"_mid": at(0.5), "_low": at(0.25), "_high": at(0.75)}, "_n").alias("b")
    far = F.abs(F.col(x) - F.col("_mid")) > F.greatest(F.lit(floor), spread * (F.col("_high") - F.col("_low")))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by]
    return df.alias("d").join(dealt(bounds), same).where(~F.coalesce((F.col("_n") >= least) & far, F.lit(False))).select("d.*")


def _within_limit(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    """Rows kept of series sorted by key and frame (the last two columns: frame, y); carries the last point kept."""
    key, last = None, None
    for batch in batches:
        *by, frames, ys = [c.to_pylist() for c in batch.columns]
        keep = []
        for i, (of, frame, y) in enumerate(zip(zip(*by), frames, ys)):
            if of != key:
                key, last = of, None
            if last is None or abs(y - last[1]) <= limit * (frame - last[0]):
                last = (frame, y)
                keep.append(i)
        yield batch.take(pa.array(keep, pa.int64()))


def speed_limit(df: DataFrame, by: list[str], frame: str, y: str, limit: float = 60.0) -> DataFrame:
    """Rows that moved more than ``limit`` a frame since the last row kept go; rows without a frame or y take no part.

    Each key's sorted series streams through one task that holds one batch and the last point kept.
    """
    rows = df.where(F.col(y).isNotNull() & F.col(frame).isNotNull()).select(*by, frame, y)
    return rows.repartition(*by).sortWithinPartitions(*by, frame, y).mapInArrow(partial(_within_limit, limit=limit), rows.schema)


def order_statistics(df: DataFrame, by: list[str], x: str, wanted: dict[str, Callable[[Column], Column]], count: str = "n") -> DataFrame:
    """by, ``count`` and for each of ``wanted`` the value at a zero-based place in the order of the key's values, nulls left out.

    ``wanted`` gives the place from the number of values. Values are counted, the counts summed over value
    ranges, and only the ranges that hold a wanted place are ordered within one task, so a key with any
    number of rows is spread over all ranges. Keys without values have a count of 0 and nulls.
    """
    counts = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("_n"))
    ranged = written(counts.repartitionByRange(*by, x).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_sum").over(Window.partitionBy(*by))
    placed = sums.select(*by, "_range", "_sum", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"), total.alias("_all"))
    places = F.array(*[place(F.col("_all")).cast("long") for place in wanted.values()])
    held = placed.withColumn("_places", places).where(F.exists("_places", lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_sum"))))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"h.{c}")) for c in [*by, "_range"]]
    upto = Window.partitionBy(*by, "_range").orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    within = ranged.alias("r").join(held.alias("h"), same).select(*[F.col(f"r.{c}") for c in [*by, "_range", x]], "_n", "_before", "_all", "_places").withColumn("_upto", F.col("_before") + F.sum("_n").over(upto))
    here = lambda i: (F.col("_places")[i] < F.col("_upto")) & (F.col("_places")[i] >= F.col("_upto") - F.col("_n"))
    found = within.groupBy(*by).agg(F.max("_all").alias(count), *[F.max(F.when(here(i), F.col(x))).alias(name) for i, name in enumerate(wanted)]).alias("m")
    keys = df.select(*by).distinct().alias("k")
    shown = [F.coalesce(F.col(f"m.{count}"), F.lit(0)).alias(count), *[F.col(f"m.{name}") for name in wanted]]
    return keys.join(found, [F.col(f"k.{c}").eqNullSafe(F.col(f"m.{c}")) for c in by], "left").select(*[F.col(f"k.{c}") for c in by], *shown)


def upper_median(df: DataFrame, by: list[str], x: str, name: str) -> DataFrame:
    """by, ``name``: the element at floor(n / 2) of each key's values in order, nulls left out."""
    return order_statistics(df, by, x, {name: lambda n: F.floor(n / 2)}, "_n").drop("_n")


def percentiles(df: DataFrame, by: list[str], x: str, wanted: dict[str, float]) -> DataFrame:
    """by and the percentiles of each key's values interpolated at (n - 1) * p, 0 for no values."""
    places = {}
    for name, p in wanted.items():
        places |= {f"_lo_{name}": lambda n, p=p: F.floor((n - 1) * p), f"_hi_{name}": lambda n, p=p: F.ceil((n - 1) * p)}
    o = order_statistics(df, by, x, places, "_n")
    share = lambda p: (F.col("_n") - 1) * p - F.floor((F.col("_n") - 1) * p)
    return o.select(*by, *[F.coalesce(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * share(p), F.lit(0.0)).alias(n) for n, p in wanted.items()])


def medoid(df: DataFrame, by: list[str], at: str, angle: str, period: float = 180.0) -> DataFrame:
    """by, medoid: each key's angle with the least sum of circular distances to all its rows, the first of equals.

    Rows are counted by distinct angle first. Along two turns of the circle running counts and sums of the angles give each angle's
    cost from their values half a turn behind, at, and half a turn ahead of it, so a key's angles stream through one sorted pass.
    """
    half = period / 2
    counts = df.where(F.col(angle).isNotNull()).groupBy(*by, F.col(angle).alias("_angle")).agg(F.count(F.lit(1)).alias("_n"), F.min(at).alias("_first"))
    place = F.pmod(F.col("_angle").cast("double"), F.lit(float(period)))
    here = F.when(place < half, place + period).otherwise(place)
    point = lambda x: F.struct(x.alias("x"), F.lit(1).alias("kind"), F.col("_n").cast("double").alias("n"))
    probe = lambda x, kind: F.struct(x.alias("x"), F.lit(kind).alias("kind"), F.lit(0.0).alias("n"))
    spread = counts.select(*by, "_angle", "_first", here.alias("_here"), F.explode(F.array(point(place), point(place + period), probe(here - half, -2), probe(here, -1), probe(here + half, 0))).alias("_e"))
    before = Window.partitionBy(*by).orderBy("_e.x", "_e.kind").rowsBetween(Window.unboundedPreceding, 0)  # probes come before points of their place
    summed = spread.withColumns({"_count": F.sum("_e.n").over(before), "_sum": F.sum(F.col("_e.n") * F.col("_e.x")).over(before)})
    of = lambda c, kind: F.max(F.when(F.col("_e.kind") == kind, F.col(c)))
    low, mid, high = ((of("_count", k), of("_sum", k)) for k in (-2, -1, 0))
    cost = F.col("_here") * (2 * mid[0] - low[0] - high[0]) - (2 * mid[1] - low[1] - high[1])
    costs = summed.where("_e.kind <= 0").groupBy(*by, "_angle", "_first", "_here").agg(cost.alias("_cost"))
    return costs.groupBy(*by).agg(F.min_by("_angle", F.struct("_cost", "_first", "_angle")).alias("medoid"))


def fit_parabola(df: DataFrame, by: list[str], x: Column, y: Column) -> DataFrame:
    """by, n, a, b, c: least squares of y on a + b x + c x**2 for each key; nulls below three points or if singular."""
    powers = [F.lit(1.0), x, x * x, x * x * x, x * x * x * x]
    sums = df.where(x.isNotNull() & y.isNotNull()).groupBy(*by).agg(*[F.sum(p).alias(f"s{i}") for i, p in enumerate(powers)], *[F.sum(y * powers[i]).alias(f"y{i}") for i in range(3)])
    a, b, c = geometry.solve3([F.col(f"s{i + j}") for i in range(3) for j in range(3)], [F.col(f"y{i}") for i in range(3)])
    enough = lambda v: F.when(F.col("s0") >= 3, v)
    return sums.select(*by, F.col("s0").cast("long").alias("n"), enough(a).alias("a"), enough(b).alias("b"), enough(c).alias("c"))


def trimmed_arc(df: DataFrame, by: list[str], along: str, across: str, rounds: int = 3, trim: float = 2.0) -> DataFrame:
    """A parabola of ``across`` on ``along`` for each key, refitted ``rounds`` times without points beyond max(2, trim * median residual).

    Each round's residuals are written, as both its median and its cut read them; the median is spread over value ranges, so a key may have
    any number of points.
    """
    kept = df.select(*by, along, across)
    for _ in range(rounds):
        fit = fit_parabola(kept, by, F.col(along), F.col(across))
        off = written(kept.join(fit, by).withColumn("_r", F.abs(F.col(across) - (F.col("a") + F.col("b") * F.col(along) + F.col("c") * F.col(along) * F.col(along)))), "residuals")
        bound = percentiles(off, by, "_r", {"_mid": 0.5})
        kept = written(off.join(bound, by).where(F.col("_r") <= F.greatest(F.lit(2.0), trim * F.col("_mid"))).select(*by, along, across), "kept")
    return fit_parabola(kept, by, F.col(along), F.col(across))


def line_of_pixels(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """by, theta_deg, elongation, rms: total least squares line through points, by central second moments."""
    m = df.groupBy(*by).agg(F.var_pop(x).alias("xx"), F.var_pop(y).alias("yy"), F.covar_pop(x, y).alias("xy"))
    root = F.sqrt(F.pow(F.col("xx") - F.col("yy"), 2) + 4 * F.col("xy") * F.col("xy"))
    wide, narrow = (F.col("xx") + F.col("yy") + root) / 2, F.greatest((F.col("xx") + F.col("yy") - root) / 2, F.lit(0.0))
    return m.select(*by, (F.degrees(F.atan2(2 * F.col("xy"), F.col("xx") - F.col("yy"))) / 2).alias("theta_deg"), F.when(narrow > 0, F.sqrt(wide / narrow)).alias("elongation"), F.sqrt(narrow).alias("rms"))


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each key; end ``order`` with a unique column so that ties are settled."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
