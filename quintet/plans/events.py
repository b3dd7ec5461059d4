"""Driver tables as inputs of the engine: events as transactions, embeddings as references.

An extension for queries: `events` carries no transaction history, so what a
payload would bring is derived per user in (ts, event_id) order. Sums are taken
in whole cents, so that no order of addition shows in a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quintet.schema import Scale

#: Values go up to about 490; one event type is missing from the map on purpose.
SCALE = Scale(max_amount=500.0, max_minutes=1440.0, max_km=1000.0, max_tx_count_24h=20.0, max_merchant_avg_amount=500.0)
RISK = {"view": 0.15, "click": 0.30, "signup": 0.45, "error": 0.80}
DAY_US = 24 * 3600 * 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def history(events: DataFrame) -> DataFrame:
    """events with us, cents, k, and what the user did before: last_us, last_k, avg_cents, tx24, known."""
    at = F.col("ts").cast("timestamp")
    base = events.select(
        "event_id", "user_id", "event_type", "value", at.alias("at"), F.unix_micros(at).alias("us"),
        F.round(F.col("value") * 100.0).cast("long").alias("cents"), F.from_json("props", "k bigint")["k"].alias("k"),
    ).withColumn("shop", F.concat(F.lit("M"), (F.col("k") % 10).cast("string")))
    mine = W.partitionBy("user_id").orderBy("us", "event_id")
    before = mine.rowsBetween(W.unboundedPreceding, -1)
    day = W.partitionBy("user_id").orderBy("us").rangeBetween(-DAY_US, 0)
    return base.select(
        "*", F.lag("us").over(mine).alias("last_us"), F.lag("k").over(mine).alias("last_k"),
        F.sum("cents").over(before).alias("before_cents"), F.count("*").over(before).alias("before_n"),
        (F.count("*").over(day) - 1).alias("tx24"), F.collect_set("shop").over(before).alias("known"),
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as transactions: idx and the payload columns, and event_type for labels."""
    rows = history(table(spark, sf_dir, "events"))
    # averages of five types: a small table that joins back by key
    types = rows.groupBy("event_type").agg((F.sum("cents") / 100.0 / F.count("*")).alias("type_avg"))
    rows = rows.join(types, "event_type")
    online = F.col("k") % 2 == 0
    usual = F.when(F.col("before_n") > 0, F.col("before_cents") / 100.0 / F.col("before_n")).otherwise(F.col("cents") / 100.0)
    return rows.select(
        F.col("event_id").alias("idx"), "event_type", F.col("event_id").cast("string").alias("id"),
        F.struct((F.col("cents") / 100.0).alias("amount"), (1 + F.col("k") % 12).cast("int").alias("installments"), F.col("at").alias("requested_at")).alias("transaction"),
        F.struct(usual.alias("avg_amount"), F.col("tx24").cast("int").alias("tx_count_24h"), F.col("known").alias("known_merchants")).alias("customer"),
        F.struct(F.col("shop").alias("id"), F.col("event_type").alias("mcc"), F.col("type_avg").alias("avg_amount")).alias("merchant"),
        F.struct(online.alias("is_online"), (~online & (F.col("k") % 3 != 0)).alias("card_present"), (F.col("k") * 10.0).alias("km_from_home")).alias("terminal"),
        F.when(F.col("last_us").isNotNull(), F.struct(F.timestamp_micros("last_us").alias("timestamp"), (F.abs(F.col("k") - F.col("last_k")) * 10.0).alias("km_from_current"))).alias("last_transaction"),
    )


#: The same in SQL, up to the features before rounding.
FEATURES_SQL = """
WITH base AS (
  SELECT event_id, user_id, event_type, ts, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS cents,
         CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events),
past AS (
  SELECT *, lag(us) OVER mine AS last_us, lag(k) OVER mine AS last_k,
         sum(cents) OVER (mine ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_cents,
         count(*) OVER (mine ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before_n,
         count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) - 1 AS tx24,
         count(*) OVER (PARTITION BY user_id, k % 10 ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM base WINDOW mine AS (PARTITION BY user_id ORDER BY us, event_id)),
types AS (SELECT event_type, CAST(sum(cents) AS DOUBLE) / 100 / count(*) AS type_avg FROM base GROUP BY 1),
raw AS (
  SELECT event_id, event_type,
    cents / CAST(100 AS DOUBLE) / 500 AS d0,
    (1 + k % 12) / CAST(12 AS DOUBLE) AS d1,
    CASE WHEN (CASE WHEN before_n > 0 THEN CAST(before_cents AS DOUBLE) / 100 / before_n ELSE cents / CAST(100 AS DOUBLE) END) = 0
         THEN CASE WHEN cents = 0 THEN CAST('nan' AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END
         ELSE (cents / CAST(100 AS DOUBLE)) / (CASE WHEN before_n > 0 THEN CAST(before_cents AS DOUBLE) / 100 / before_n ELSE cents / CAST(100 AS DOUBLE) END) / 10 END AS d2,
    hour(ts) / CAST(23 AS DOUBLE) AS d3,
    (isodow(ts) - 1) / CAST(6 AS DOUBLE) AS d4,
    CASE WHEN last_us IS NULL THEN -1 ELSE ((us // 1000000) - (last_us // 1000000)) / CAST(60 AS DOUBLE) / 1440 END AS d5,
    CASE WHEN last_us IS NULL THEN -1 ELSE abs(k - last_k) * CAST(10 AS DOUBLE) / 1000 END AS d6,
    k * CAST(10 AS DOUBLE) / 1000 AS d7,
    tx24 / CAST(20 AS DOUBLE) AS d8,
    CASE WHEN k % 2 = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS d9,
    CASE WHEN k % 2 <> 0 AND k % 3 <> 0 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS d10,
    CASE WHEN seen > 0 THEN CAST(0 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS d11,
    CASE event_type WHEN 'view' THEN CAST(0.15 AS DOUBLE) WHEN 'click' THEN CAST(0.30 AS DOUBLE) WHEN 'signup' THEN CAST(0.45 AS DOUBLE) WHEN 'error' THEN CAST(0.80 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS d12,
    type_avg / 500 AS d13
  FROM past JOIN types USING (event_type)),
vectors AS (
  SELECT event_id, event_type, round(clamp(d0) * 10000) / 10000 AS d0, round(clamp(d1) * 10000) / 10000 AS d1, round(clamp(d2) * 10000) / 10000 AS d2,
    round(d3 * 10000) / 10000 AS d3, round(d4 * 10000) / 10000 AS d4,
    CASE WHEN d5 = -1 THEN CAST(-1 AS DOUBLE) ELSE round(clamp(d5) * 10000) / 10000 END AS d5, CASE WHEN d6 = -1 THEN CAST(-1 AS DOUBLE) ELSE round(clamp(d6) * 10000) / 10000 END AS d6,
    round(clamp(d7) * 10000) / 10000 AS d7, round(clamp(d8) * 10000) / 10000 AS d8, d9, d10, d11, d12, round(clamp(d13) * 10000) / 10000 AS d13
  FROM raw)
"""


def _spelled(sql: str) -> str:
    """clamp(x) written out, so that NaN stays NaN as it does in the engine."""
    import re

    return re.sub(r"clamp\((d\d+)\)", r"(CASE WHEN isnan(\1) THEN \1 WHEN \1 < 0 THEN 0 WHEN \1 > 1 THEN 1 ELSE \1 END)", sql)


FEATURES_SQL = _spelled(FEATURES_SQL)
