"""Results by participant and submission, where the latest one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quintet.functions.scalars import ISO


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Each key's last row by order; the rest are superseded."""
    last = W.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(last)).filter("__n = 1").drop("__n")


def stamped(rows: DataFrame, column: str = "timestamp") -> DataFrame:
    """rows with the time of the query, as ISO-8601 UTC text of seconds."""
    return rows.withColumn(column, F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), ISO))


def upsert(registry: DataFrame, new: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """registry with new's rows in place of those of equal keys; of several new ones the latest by timestamp."""
    keys = keys or ["participant", "submission"]
    own = latest(new, keys, ["timestamp"])
    return registry.join(own.select(*keys), keys, "left_anti").unionByName(own, allowMissingColumns=True)


def nested(registry: DataFrame) -> DataFrame:
    """One row of map<participant, map<submission, result>>; a registry is small by its nature."""
    result = F.struct(*[c for c in registry.columns if c not in ("participant", "submission")])
    by_one = registry.groupBy("participant").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("submission"), result.alias("result"))))).alias("submissions"))
    return by_one.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("participant", F.to_json("submissions").alias("submissions"))))).alias("registry"))


def resolve(participants: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (participant, submission) with the repo; "default" is the participant's first submission."""
    first = F.element_at("submissions", 1)["id"]
    wanted = asked.join(participants, "participant")
    wanted = wanted.withColumn("submission", F.when(F.col("submission") == "default", first).otherwise(F.col("submission")))
    return wanted.withColumn("repo", F.get(F.filter("submissions", lambda s: s["id"] == F.col("submission")), F.lit(0))["repo"]).drop("submissions")
