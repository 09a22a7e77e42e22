"""Mix sources to target weights with DataFrame operations only.

Every document gets a hash-random key. Within a source the documents are ordered by that key, a
distributed prefix sum of their sizes is taken, and the source is cut at its exact budget; a budget
beyond the source's size repeats whole epochs first.

The prefix sum is distributed: a source of n documents is cut into sqrt(n) key ranges, the ranges are
summed and prefix-summed (sqrt(n) rows), and only a range (sqrt(n) documents) is ordered within one
task. A source that holds a third of all rows is just more ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table, word_count


def source_targets(sizes: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """Targets by weight, none above ``cap`` times its source's size.

    ``sizes``: one row for each ``source`` with ``source_size`` and ``source_docs``. Sources in code
    point order (null last) get the weights in turn. The excess of capped sources is shared by weight
    among the others until none is above its cap: that is ``least(cap, level * weight)`` for one level,
    found by a prefix sum over the sources in the order in which they reach their caps.
    One task holds this table and orders it twice: a row of a few numbers for each source, good for some millions
    of them, not for one a document.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("_r", (F.row_number().over(by_name) - 1) % len(weights))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_r") + 1).cast("int"))
    capped = ranked.withColumn("_w", weight).withColumn("_cap", (F.col("source_size") * cap).cast("double"))
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last())
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(rest)
    return (
        capped.withColumn("_level", level)
        .withColumn("_level", F.max("_level").over(everything))
        .select("source", "source_size", "source_docs", F.least(F.col("_cap"), F.col("_level") * F.col("_w")).alias("target"))
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    cap: int = 3,
    seed: str = "mix",
    keep: Sequence[str] = (),
) -> DataFrame:
    """How many words of each document the mix takes.

    ``docs``: doc_id, text, source; other columns are ignored unless named in ``keep``, which are
    carried as one struct ``row`` so that no name can clash. Returns doc_id, source, size,
    source_size, target, taken (repeats counted), and if asked for ``row`` with ``first``: whether it is the
    first document with words that its source's order draws.

    Defined cases: a null text has no words; the null source is a source of its own, the last;
    a null doc_id hashes as the empty string; rows that are alike in id and size are interchangeable,
    so repeated rows give the same result on every run; an empty table gives an empty result; if no
    document has words every target is 0. The boundary document of a cut is taken in part.
    """
    row = [F.struct(*[F.col(c) for c in keep]).alias("row")] if keep else []
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    sized = staged(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), key.alias("_key"), *row), "mix-sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_docs"))
    targets = staged(source_targets(sizes, weights, cap), "mix-targets")

    blocks = F.ceil(F.sqrt("source_docs")).cast("long")
    head = F.conv(F.substring("_key", 1, 8), 16, 10).cast("long")
    placed = (
        sized.alias("d")
        .join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.*", "t.source_size", "t.target", F.shiftright(head * blocks, 32).alias("_block"))
    )
    sums = placed.groupBy("source", "_block").agg(F.sum("size").alias("_sum"))
    earlier = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("source", "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("source", "_block").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = placed.withColumn("_before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    cut = F.round(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long") - F.col("_offset") - F.col("_before")
    first = ((F.col("_offset") + F.col("_before")) == 0) & (F.col("size") > 0)
    return (
        local.alias("l")
        .join(offsets.alias("o"), F.col("l.source").eqNullSafe(F.col("o.source")) & (F.col("l._block") == F.col("o._block")))
        .select("l.*", "o._offset")
        .withColumn("_epochs", epochs)
        .withColumn("taken", F.col("_epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), cut)))
        .select("doc_id", "source", "size", "source_size", "target", "taken", *(["row", first.alias("first")] if keep else []))
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: each is repeated for every epoch that takes it, and left out if none does.

    A document that a cut divides is kept whole if at least half of it is taken, which brings the source's total
    as near its target as whole documents can, by half a document; a source with a target keeps the first
    document that it draws in any case.
    """
    columns = docs.columns
    mixed = mix(docs, keep=columns, **options)
    times = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    times = F.when(F.col("first") & (F.col("taken") > 0), F.greatest(times, F.lit(1))).otherwise(times)
    return mixed.where(times > 0).select(F.explode(F.array_repeat(F.col("row"), times)).alias("row")).select(*[F.col("row")[c].alias(c) for c in columns])


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(doc_id::VARCHAR, '') || ':mix') AS k
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS w,
             (3 * source_size)::DOUBLE AS cap FROM s),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
             / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM r),
t AS (SELECT source, source_size, least(cap, max(lv) OVER () * w) AS target FROM l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS e,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS b
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (e * size + greatest(0, least(size, round(target - e * source_size)::BIGINT - b)))::BIGINT AS taken
FROM p
"""
