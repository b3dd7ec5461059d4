"""Grading of responses: confusion counts, latency percentile and logarithmic scores.

"Positive" is a denied transaction. A response of status 200 that agrees with
the expected decision is right; one that doesn't is a missed fraud if it
approves and a false block otherwise, also if it says nothing; any other status
is an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quintet.functions.scalars import percent

#: Fixed values of the scoring rules.
SCALE, MOST_MS, LEAST_P99, CUT_P99, LEAST_EPSILON, BETA, CUT_RATE, CUT_SCORE = 1000.0, 1000.0, 1.0, 2000.0, 0.001, 300.0, 0.15, -3000.0


def confusion(graded: DataFrame) -> DataFrame:
    """One row of tp, tn, fp, fn, errors, of (status, approved, expected_approved)."""
    answered = F.col("status") == 200
    said = F.coalesce(F.col("approved"), F.lit(False))
    right = F.coalesce(F.col("approved") == F.col("expected_approved"), F.lit(False))
    return graded.agg(
        F.count_if(answered & right & ~said).alias("tp"),
        F.count_if(answered & right & said).alias("tn"),
        F.count_if(answered & ~right & ~said).alias("fp"),
        F.count_if(answered & ~right & said).alias("fn"),
        F.count_if(~F.coalesce(answered, F.lit(False))).alias("errors"),
    )


#: Of so many ranks one is the most by which a sketch's percentile is off.
ACCURACY = 10_000


def p99(rows: DataFrame, ms: str, share: float = 0.99) -> DataFrame:
    """One row of p99: the exact percentile, interpolated; null without values.

    A sketch brackets it between two values; only those between them, one in some
    thousand, are counted by value and summed in order.
    """
    value = rows.select(F.col(ms).cast("double").alias("v")).filter("v is not null")
    edges = [max(0.0, share - 3 / ACCURACY), min(1.0, share + 3 / ACCURACY)]
    bounds = value.agg(F.count("*").alias("n"), F.percentile_approx("v", F.array(*map(F.lit, edges)), F.lit(ACCURACY)).alias("b"))
    both = value.crossJoin(F.broadcast(bounds))  # one row
    under = F.col("v") < F.col("b")[0]
    below = both.agg(F.count_if(under).alias("below"), F.max(F.when(under, F.col("v"))).alias("last"), (F.lit(share) * (F.first("n") - 1)).alias("at"))
    counted = both.filter("v between b[0] and b[1]").groupBy("v").agg(F.count("*").alias("c"))
    upto = counted.withColumn("upto", F.sum("c").over(W.orderBy("v"))).crossJoin(F.broadcast(below))
    found = upto.withColumn("upto", F.col("upto") + F.col("below")).agg(
        F.first("at").alias("at"),
        # of few values the rank below may lie one under the bracket
        F.when(F.first("below") > F.floor(F.first("at")), F.first("last")).otherwise(F.min(F.when(F.col("upto") > F.floor("at"), F.col("v")))).alias("lo"),
        F.min(F.when(F.col("upto") > F.ceil("at"), F.col("v"))).alias("hi")
    )
    return found.select((F.col("lo") + (F.coalesce("hi", "lo") - F.col("lo")) * (F.col("at") - F.floor("at"))).alias("p99"))


def p99_score(p: Column) -> Column:
    log = F.lit(SCALE) * F.log10(F.lit(MOST_MS) / F.greatest(p, F.lit(LEAST_P99)))
    return F.when(p <= 0, F.lit(0.0)).when(p > CUT_P99, F.lit(CUT_SCORE)).otherwise(log)


def scored(counts: DataFrame) -> DataFrame:
    """counts (tp, tn, fp, fn, errors, p99) with every part of the score; parts of a cut score are null."""
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") + F.col("errors")
    weighted = (F.col("fp") + 3 * F.col("fn") + 5 * F.col("errors")).cast("long")
    failed = F.col("fp") + F.col("fn") + F.col("errors")
    out = counts.withColumn("n", n).withColumn("weighted_errors", weighted).withColumn("failures", failed)
    share = lambda x: F.when(F.col("n") > 0, F.try_divide(F.col(x).cast("double"), F.col("n").cast("double"))).otherwise(F.lit(0.0))
    out = out.withColumn("epsilon", share("weighted_errors")).withColumn("failure_rate", share("failures"))
    cut = F.col("failure_rate") > CUT_RATE
    rate = F.lit(SCALE) * F.log10(F.lit(1.0) / F.greatest(F.col("epsilon"), F.lit(LEAST_EPSILON)))
    penalty = F.lit(0.0) - F.lit(BETA) * F.log10(F.lit(1.0) + F.col("weighted_errors"))  # not -0
    return (
        out.withColumn("p99_score", p99_score(F.col("p99"))).withColumn("p99_cut", F.col("p99") > CUT_P99)
        .withColumn("rate_component", F.when(~cut, rate)).withColumn("absolute_penalty", F.when(~cut, penalty))
        .withColumn("detection_score", F.when(cut, F.lit(CUT_SCORE)).otherwise(rate + penalty)).withColumn("detection_cut", cut)
        .withColumn("final_score", F.col("p99_score") + F.col("detection_score"))
    )


def report(scores: DataFrame, expected: Column | None = None) -> DataFrame:
    """The nested report, rounded as it is published, in a column `report`."""
    two = lambda c: F.round(c, 2)
    return scores.select(
        F.struct(
            (expected if expected is not None else F.lit(None).cast("string")).alias("expected"),
            F.concat(F.format_string("%.2f", "p99"), F.lit("ms")).alias("p99"),
            F.struct(
                F.struct(
                    F.col("fp").alias("false_positive_detections"), F.col("fn").alias("false_negative_detections"),
                    F.col("tp").alias("true_positive_detections"), F.col("tn").alias("true_negative_detections"), F.col("errors").alias("http_errors"),
                ).alias("breakdown"),
                percent(F.col("failure_rate")).alias("failure_rate"),
                F.col("weighted_errors").alias("weighted_errors_E"),
                F.round("epsilon", 6).alias("error_rate_epsilon"),
                F.struct(two("p99_score").alias("value"), F.col("p99_cut").alias("cut_triggered")).alias("p99_score"),
                F.struct(
                    two("detection_score").alias("value"), two("rate_component").alias("rate_component"),
                    two("absolute_penalty").alias("absolute_penalty"), F.col("detection_cut").alias("cut_triggered"),
                ).alias("detection_score"),
                two("final_score").alias("final_score"),
            ).alias("scoring"),
        ).alias("report")
    )


def graded(expected: DataFrame, responses: DataFrame, key: str = "idx") -> DataFrame:
    """Expected decisions joined to the responses that there were; entries never asked for don't count."""
    return expected.select(key, "expected_approved").join(responses.select(key, "status", "approved"), key)


def label_stats(rows: DataFrame, edge: float = 0.6) -> DataFrame:
    """One row of counts and rates over (approved, fraud_score)."""
    total = F.count("*")
    rate = lambda n: F.when(total > 0, F.round(n / total * F.lit(10000.0)) / F.lit(10000.0)).otherwise(F.lit(0.0))
    fraud, legit, edges = F.count_if(~F.col("approved")), F.count_if("approved"), F.count_if(F.col("fraud_score") == edge)
    return rows.agg(
        total.alias("total"), fraud.alias("fraud_count"), legit.alias("legit_count"), rate(fraud).alias("fraud_rate"),
        rate(legit).alias("legit_rate"), edges.alias("edge_case_count"), rate(edges).alias("edge_case_rate"),
    )
