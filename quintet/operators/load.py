"""How many requests a ramping load plan makes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def stages_of(spark: SparkSession, script: str) -> tuple[DataFrame, int]:
    """(stage_no, duration_s, target) and the start rate, scraped from the text of a load script."""
    one = spark.createDataFrame([(script,)], "text string").select(
        F.regexp_extract("text", r"startRate:\s*(\d+)", 1).cast("int").alias("start"),
        F.regexp_extract_all("text", F.lit(r"duration:\s*'([0-9]+)")).alias("durations"),
        F.regexp_extract_all("text", F.lit(r"target:\s*(\d+)")).alias("targets"),
    )
    stages = one.select(F.posexplode(F.arrays_zip("durations", "targets")).alias("at", "s")).select(
        (F.col("at") + 1).alias("stage_no"), F.col("s.durations").cast("int").alias("duration_s"), F.col("s.targets").cast("int").alias("target")
    )
    return stages, one.first()["start"]


def estimated(stages: DataFrame, start_rate: int) -> DataFrame:
    """stages with the rate they start from, their requests (a trapezoid, whole) and the sum so far."""
    order = W.orderBy("stage_no")  # a load plan is a handful of stages
    before = F.lag("target", 1, start_rate).over(order)
    requests = F.expr("(from_rate + target) * duration_s div 2")
    return stages.withColumn("from_rate", before).withColumn("stage_reqs", requests).withColumn("cumulative", F.sum("stage_reqs").over(order.rowsBetween(W.unboundedPreceding, 0)))


def total(estimate: DataFrame) -> DataFrame:
    """One row of the plan's seconds and requests."""
    return estimate.agg(F.sum("duration_s").alias("total_duration_s"), F.sum("stage_reqs").alias("total_requests"))


def table_lines(estimate: DataFrame, start_rate: int) -> DataFrame:
    """(at, line) of the plan as a framed table, with a row of totals."""
    names = ["stage", "duration", "from", "to", "stage_reqs", "cumulative"]
    text = lambda c: F.col(c).cast("string")
    rows = estimate.select(
        F.col("stage_no").cast("long").alias("at"), text("stage_no").alias(names[0]), F.concat(text("duration_s"), F.lit("s")).alias(names[1]), text("from_rate").alias(names[2]),
        text("target").alias(names[3]), text("stage_reqs").alias(names[4]), text("cumulative").alias(names[5]),
    )
    last = estimate.agg(F.sum("duration_s").alias("d"), F.max_by("target", "stage_no").alias("t"), F.sum("stage_reqs").alias("n"), F.max("stage_no").cast("long").alias("at"))
    totals = last.select(
        (F.col("at") + 2).alias("at"), F.lit("total").alias(names[0]), F.concat(text("d"), F.lit("s")).alias(names[1]), F.lit(str(start_rate)).alias(names[2]),
        text("t").alias(names[3]), F.lit("").alias(names[4]), text("n").alias(names[5]),
    )
    every = rows.union(totals)
    wide = widths(every.select(*names)).select(F.struct(*names).alias("w"))  # one row, of six numbers
    line = lambda left, mid, right: F.concat(F.lit(left), F.concat_ws(mid, *[F.repeat(F.lit("\u2500"), F.col(f"w.{c}") + 2) for c in names]), F.lit(right))
    row = lambda cells: F.concat(F.lit("\u2502 "), F.concat_ws(" \u2502 ", *cells), F.lit(" \u2502"))
    body = every.crossJoin(F.broadcast(wide)).select("at", row([F.lpad(F.col(c), F.col(f"w.{c}"), " ") for c in names]).alias("line"))
    end = wide.crossJoin(F.broadcast(last.select("at")))
    frame = [(F.lit(-2), line("\u250c", "\u252c", "\u2510")), (F.lit(-1), row([F.rpad(F.lit(c), F.col(f"w.{c}"), " ") for c in names])), (F.lit(0), line("\u251c", "\u253c", "\u2524")), (F.col("at") + 1, line("\u251c", "\u253c", "\u2524")), (F.col("at") + 3, line("\u2514", "\u2534", "\u2518"))]
    return body.union(end.select(F.explode(F.array(*[F.struct(a.cast("long").alias("at"), x.alias("line")) for a, x in frame])).alias("f")).select("f.*"))


def widths(rows: DataFrame) -> DataFrame:
    """One row of each column's greatest printed width, its name included."""
    return rows.agg(*[F.greatest(F.max(F.length(F.col(c).cast("string"))), F.lit(len(c))).alias(c) for c in rows.columns])
