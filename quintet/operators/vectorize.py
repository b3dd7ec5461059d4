"""Transactions to normalised 14-dimensional vectors, one expression a dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quintet.functions.scalars import clamp01, day_of_week, divided, first_match, minutes_between, round4
from quintet.schema import CODE_CHARS, DEFAULT_RISK, MCC_RISK, MOST_CODES, Scale

NAMES = (
    "amount", "installments", "amount_vs_avg", "hour_of_day", "day_of_week", "minutes_since_last", "km_from_last",
    "km_from_home", "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_avg_amount",
)


def usable(risk: dict[str, float]) -> list[tuple[str, float]]:
    """What a lookup sees of a risk map: its first entries, with codes cut."""
    return [(k[:CODE_CHARS], v) for k, v in list(risk.items())[:MOST_CODES]]


def features(scale: Scale | None = None, risk: dict[str, float] | None = None) -> dict[str, Column]:
    """The dimensions, by name and in order, before rounding. -1 stands for no last transaction."""
    s = scale or Scale()
    at, last = F.col("transaction.requested_at"), F.col("last_transaction")
    scaled = lambda x, most: clamp01(F.col(x).cast("double") / F.lit(most))
    flag = lambda x: F.when(F.col(x), F.lit(1.0)).otherwise(F.lit(0.0))
    known = F.array_contains("customer.known_merchants", F.col("merchant.id"))  # null counts as unknown
    values = (
        scaled("transaction.amount", s.max_amount),
        scaled("transaction.installments", s.max_installments),
        clamp01(divided("transaction.amount", "customer.avg_amount") / F.lit(s.amount_vs_avg_ratio)),
        F.hour(at) / F.lit(23.0),
        day_of_week(at) / F.lit(6.0),
        F.when(last.isNull(), F.lit(-1.0)).otherwise(clamp01(minutes_between(at, "last_transaction.timestamp") / F.lit(s.max_minutes))),
        F.when(last.isNull(), F.lit(-1.0)).otherwise(scaled("last_transaction.km_from_current", s.max_km)),
        scaled("terminal.km_from_home", s.max_km),
        scaled("customer.tx_count_24h", s.max_tx_count_24h),
        flag("terminal.is_online"),
        flag("terminal.card_present"),
        F.when(known, F.lit(0.0)).otherwise(F.lit(1.0)),
        first_match(usable(MCC_RISK if risk is None else risk), F.col("merchant.mcc"), DEFAULT_RISK),
        scaled("merchant.avg_amount", s.max_merchant_avg_amount),
    )
    return dict(zip(NAMES, values, strict=True))


def vector(scale: Scale | None = None, risk: dict[str, float] | None = None) -> Column:
    """The rounded vector that is searched with and searched among."""
    return F.array(*[round4(x) for x in features(scale, risk).values()])


def vectorize(transactions: DataFrame, scale: Scale | None = None, risk: dict[str, float] | None = None) -> DataFrame:
    """(id, vector)"""
    return transactions.select("id", vector(scale, risk).alias("vector"))


def mcc_risk_join(rows: DataFrame, key: str, risk: DataFrame, default: float = DEFAULT_RISK) -> DataFrame:
    """rows with mcc_risk from a table (code, risk): a left join that keeps every row, for maps that are tables.

    Of a code that comes again the first counts, by the column `at` if the table has one.
    """
    first = F.min_by("risk", "at") if "at" in risk.columns else F.first("risk")
    table = risk.groupBy(F.col("code").alias("__code")).agg(first.alias("__risk"))
    return rows.join(table, rows[key] == table["__code"], "left").withColumn("mcc_risk", F.coalesce("__risk", F.lit(default))).drop("__code", "__risk")
