"""The session store and what is exported from it, written from given tables and read back, as registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formatting import fixed, signed
from ..sources import session_store
from ..staging import fresh_path

KINDS = ("parquet", "csv", "json")


def _records(spark, sf_dir: str) -> DataFrame:
    """A record for each order: its clerk's session, two measures, and for a few a reason not to believe them."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    wild = F.when(F.col("o_orderkey") % 11 == 0, F.lit("implausible"))
    return o.select((F.col("o_custkey") % 25).alias("session"), F.col("o_orderkey").alias("t"), (F.col("o_orderkey") % 97 / 8.0).alias("face_deg"), (F.col("o_orderkey") % 41 / 4.0).alias("ball_speed"), wild.alias("implausible"), F.array("o_orderkey").alias("face_series"))


def stored_sessions(spark, sf_dir):
    """Records saved, appended to and loaded; emptied and filled again; and exported as CSV and JSON and read back."""
    records = session_store.blank_implausible(_records(spark, sf_dir), ["face_deg"])
    path, csv, json = (fresh_path(spark, f"sessions-{k}") for k in KINDS)
    session_store.save(records, path)
    session_store.clear(spark, path)
    session_store.append(records.where("t % 2 = 0"), path)
    session_store.append(records.where("t % 2 = 1"), path)
    kept = session_store.load(spark, path).where(~F.col("has_clip"))
    session_store.export_csv(kept, csv)
    session_store.export_json(kept.select("session", "t", "face_deg", "ball_speed"), json)
    back = {"parquet": kept, "csv": spark.read.schema("`#` int, session long, t long, face_deg double, ball_speed double").csv(csv, header=True), "json": spark.read.schema("session long, t long, face_deg double, ball_speed double").json(json)}
    sums = [F.count(F.lit(1)).alias("records"), F.count("face_deg").alias("believed"), F.sum("face_deg").alias("face_total"), F.sum("ball_speed").alias("speed_total")]
    parts = [df.groupBy("session").agg(*sums).select(F.lit(kind).alias("kind"), F.col("session").cast("long").alias("session"), "records", "believed", "face_total", "speed_total") for kind, df in back.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def shown_numbers(spark, sf_dir):
    """Numbers with fixed decimals and with signs, a dash for what is none."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    off = F.when(F.col("l_linenumber") != 3, F.round(F.col("l_tax") * 100) - 4)
    return rows.select("l_orderkey", "l_linenumber", fixed(F.round(F.col("l_extendedprice"), 2), 2).alias("price"), signed(off, 1).alias("off")).groupBy("off").agg(F.count(F.lit(1)).alias("rows"), F.min("price").alias("least"), F.max("price").alias("most"))


QUERIES = {f.__name__: f for f in (stored_sessions, shown_numbers)}

ORACLE_SQL = {
    "stored_sessions": """
        WITH r AS (SELECT (o_custkey % 25)::BIGINT AS session, CASE WHEN o_orderkey % 11 <> 0 THEN (o_orderkey % 97) / 8.0::DOUBLE END AS face, (o_orderkey % 41) / 4.0::DOUBLE AS speed FROM orders)
        SELECT kind, session, count(*) AS records, count(face) AS believed, sum(face) AS face_total, sum(speed) AS speed_total
        FROM r, (VALUES ('parquet'), ('csv'), ('json')) k(kind) GROUP BY kind, session""",
    "shown_numbers": """
        WITH r AS (SELECT CASE WHEN l_linenumber <> 3 THEN round(l_tax * 100) - 4 END AS x, printf('%.2f', round(l_extendedprice, 2)) AS price FROM lineitem)
        SELECT CASE WHEN x IS NULL THEN '—' WHEN x > 0 THEN '+' || printf('%.1f', x) ELSE printf('%.1f', x) END AS off, count(*) AS rows, min(price) AS least, max(price) AS most FROM r GROUP BY 1""",
}
