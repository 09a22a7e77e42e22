"""Fill-in-the-middle examples, cut at limits of units, relationally.

A unit is a run of ASCII letters or one other character. Texts are exploded into pieces of bounded length and
the pieces' units and characters summed by a window, which gives every document's number of units and the piece
that each cut falls in. Cut requests meet their pieces by unit ordinal; those pieces are exploded into units, the
lengths of the units before a request's are summed, and each document's offsets are aggregated, joined to its text
and cut out of it. Texts are dealt by one key once; all else takes place where they lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

UNIT = r"[A-Za-z]+|[^A-Za-z]"
#: Characters of a piece: the larger, the fewer pieces and the more units in the two that are cut.
PIECE = 128
MARKS = ("<P>", "<S>", "<M>")
PLAIN_FROM, SPM_BELOW = 90, 20  # percent


def draws(doc_id: Column, seed: str) -> list[Column]:
    """Four unsigned numbers of 32 bits by the id; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def cut_offsets(dealt: DataFrame, *ids: str) -> DataFrame:
    """key, n, length, first, second and ``ids``: each text's number of units and characters, and the characters before its two cuts.

    ``dealt``: key (one a row), text (not null), the ``ids`` and a, b, the numbers whose remainders by n + 1 say after how
    many units to cut. Texts without characters have no row.
    """
    pieces = dealt.select("key", *ids, "a", "b", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), 0)).alias("at", "piece"))
    order = Window.partitionBy("key").orderBy("at")
    counted = pieces.withColumns({"units": F.regexp_count("piece", F.lit(UNIT)), "chars": F.length("piece"), "opens": F.col("piece").rlike(r"\A[A-Za-z]"), "closes": F.col("piece").rlike(r"[A-Za-z]\z")})
    # A run of letters that goes on from the piece before is no new unit.
    joined = counted.withColumn("joined", (F.col("opens") & F.coalesce(F.lag("closes").over(order), F.lit(False))).cast("int"))
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fresh = F.col("units") - F.col("joined")
    placed = joined.withColumns({"units_before": F.coalesce(F.sum(fresh).over(before), F.lit(0)), "chars_before": F.coalesce(F.sum("chars").over(before), F.lit(0)), "n": F.sum(fresh).over(whole), "length": F.sum("chars").over(whole)})
    # Each piece meets the requests whose unit starts in it; request 0 meets the first piece and brings the totals.
    cuts = [F.col(c) % (F.col("n") + 1) for c in "ab"]
    request = lambda cut, after: F.struct(F.lit(cut).alias("cut"), after.cast("long").alias("after"))
    asked = placed.select("*", F.explode(F.array(request(0, F.lit(0)), request(1, F.least(*cuts)), request(2, F.greatest(*cuts)))).alias("ask"))
    starts_here = F.col("ask.after").between(F.col("units_before"), F.col("units_before") + fresh - 1)
    met = asked.where(F.when(F.col("ask.cut") == 0, F.col("at") == 0).otherwise(starts_here))
    unit = (F.col("ask.after") - F.col("units_before") + F.col("joined")).alias("wanted")  # from 0, within the piece
    exploded = met.select("key", *ids, "n", "length", "chars_before", "ask.cut", unit, F.posexplode(F.regexp_extract_all("piece", F.lit(UNIT), 0)).alias("unit", "letters"))
    length_before = F.when(F.col("unit") < F.col("wanted"), F.length("letters")).otherwise(0)
    here = lambda cut: F.col("cut") == cut
    # A cut after all units starts no unit: it is the text's end.
    offset = lambda cut: F.coalesce(F.max(F.when(here(cut), F.col("chars_before"))) + F.sum(F.when(here(cut), length_before)), F.max("length"))
    return exploded.groupBy("key").agg(F.max("n").alias("n"), F.max("length").alias("length"), offset(1).alias("first"), offset(2).alias("second"), *[F.max(i).alias(i) for i in ids])


def restored(output: Column, form: Column) -> Column:
    """The text again, from an output and its form alone."""
    p, s, m = (F.locate(mark, output) for mark in MARKS)
    upto = lambda start, end: F.substring(output, start + 3, end - start - 3)
    rest = F.substring(output, m + 3, F.length(output))
    psm, spm = F.concat(upto(p, s), rest, upto(s, m)), F.concat(upto(p, m), rest, upto(s, p))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fill_in_middle(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), seed: str = "1") -> DataFrame:
    """The ``keep`` columns and n, form, prefix, middle, suffix, output of every document.

    psm is ``<P>``prefix``<S>``suffix``<M>``middle, spm ``<S>``suffix``<P>``prefix``<M>``middle. Plain, with output the text
    and null parts, are empty texts, those that hold a mark, and a tenth by the id's hash. A null text is empty, a null
    id hashes as the empty string; rows that repeat are each made alike; a very long text is pieces like any other, and no
    window holds more than one text's; an empty table gives no rows; other columns do not matter, and a kept one
    named like a column made here is refused (ValueError).
    """
    if clashing := set(keep) & {"n", "form", "prefix", "middle", "suffix", "output"}:
        raise ValueError(f"kept columns named like new ones: {sorted(clashing)}")
    row, whole = F.struct(*keep).alias("row"), F.coalesce("text", F.lit("")).alias("text")
    tagged = docs.select(row, F.col("doc_id").alias("id"), whole, F.monotonically_increasing_id().alias("key")).repartition("key")
    a, b, plain, order = draws(F.col("id"), seed)
    # The tag makes both sides read all columns of the one shuffle, so that it is made once.
    dealt = tagged.withColumns({"a": a, "b": b, "tag": F.xxhash64("row", "id")})
    offsets = cut_offsets(dealt.select("key", "text", "a", "b", "tag"), "tag").withColumnRenamed("tag", "_tag")
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains("text", F.lit(mark))
    form = F.when((F.col("text") == "") | marked | (plain % 100 >= PLAIN_FROM), "plain").when(order % 100 < SPM_BELOW, "spm").otherwise("psm")
    same = F.coalesce(F.col("tag") == F.col("_tag"), F.lit(False))
    joined = dealt.join(offsets.hint("shuffle_hash"), "key", "left").withColumns({"n": F.when(same, F.col("n")).otherwise(F.lit(0)), "form": form})
    first, second = F.col("first").cast("int"), F.col("second").cast("int")
    cut = lambda start, length: F.when(F.col("form") != "plain", F.substring("text", start, length))
    parts = joined.withColumns({"prefix": cut(F.lit(1), first), "middle": cut(first + 1, second - first), "suffix": cut(second + 1, F.length("text"))})
    p, s, m = (F.lit(mark) for mark in MARKS)
    output = F.when(F.col("form") == "psm", F.concat(p, "prefix", s, "suffix", m, "middle")).when(F.col("form") == "spm", F.concat(s, "suffix", p, "prefix", m, "middle")).otherwise(F.col("text"))
    return parts.select(*[F.col("row")[c].alias(c) for c in keep], "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def op13_infill(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP13_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
                  list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]'), lambda u: length(u)) AS u FROM documents),
k AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
             ('0x' || h[17:24])::BIGINT % 100 AS c, ('0x' || h[25:32])::BIGINT % 100 AS d FROM t),
f AS (SELECT *, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR c >= 90 THEN 'plain'
                     WHEN d < 20 THEN 'spm' ELSE 'psm' END AS form,
             coalesce(list_sum(u[1:least(a, b)]), 0)::BIGINT AS p, coalesce(list_sum(u[1:greatest(a, b)]), 0)::BIGINT AS q FROM k),
o AS (SELECT *, CASE form WHEN 'plain' THEN text
                          WHEN 'psm' THEN '<P>' || text[1:p] || '<S>' || text[q + 1:] || '<M>' || text[p + 1:q]
                          ELSE '<S>' || text[q + 1:] || '<P>' || text[1:p] || '<M>' || text[p + 1:q] END AS output FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars, CASE WHEN form <> 'plain' THEN q - p END AS middle_chars,
       sha256(output) AS output_sha256, sha256(text) AS restored_sha256 FROM o
"""
