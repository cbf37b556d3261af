"""Change logs over ordinary tables: user_key, seq, kind, value, expiry_ns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY_NS = 86_400 * 10**9


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by user: errors delete, sign-ups and purchases set, views are operands, clicks set for a day."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "error", 0).when(F.col("event_type").isin("signup", "purchase"), 1).when(F.col("event_type") == "view", 3).otherwise(4)
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return e.select(
        F.concat(F.lit("u"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("user_key"),
        (F.col("event_id") + 1).alias("seq"),
        kind.alias("kind"),
        F.when(kind != 0, F.round(F.col("value") * 100).cast("long")).alias("value"),
        F.when(kind == 4, micros * 1000 + DAY_NS).alias("expiry_ns"),
    )


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer: finished set, open ones are operands, pending delete."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind = F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 3).otherwise(0)
    return o.select(
        F.concat(F.lit("c"), F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("user_key"),
        (F.col("o_orderkey") + 1).alias("seq"),
        kind.alias("kind"),
        F.when(kind != 0, F.round(F.col("o_totalprice") * 100).cast("long")).alias("value"),
        F.lit(None).cast("long").alias("expiry_ns"),
    )


#: The same logs in DuckDB's SQL, as common table expressions.
EVENTS_SQL = """ev AS (
  SELECT 'u' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS user_key, event_id + 1 AS seq,
    CASE WHEN event_type = 'error' THEN 0 WHEN event_type IN ('signup', 'purchase') THEN 1 WHEN event_type = 'view' THEN 3 ELSE 4 END AS kind,
    CASE WHEN event_type <> 'error' THEN CAST(round(value * 100) AS BIGINT) END AS value,
    CASE WHEN event_type NOT IN ('error', 'signup', 'purchase', 'view') THEN epoch_us(ts) * 1000 + 86400000000000 END AS expiry_ns
  FROM events)"""
ORDERS_SQL = """od AS (
  SELECT 'c' || lpad(CAST(o_custkey AS VARCHAR), 8, '0') AS user_key, o_orderkey + 1 AS seq,
    CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 3 ELSE 0 END AS kind,
    CASE WHEN o_orderstatus IN ('F', 'O') THEN CAST(round(o_totalprice * 100) AS BIGINT) END AS value,
    CAST(NULL AS BIGINT) AS expiry_ns
  FROM orders)"""
