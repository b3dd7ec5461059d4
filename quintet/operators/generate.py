"""Seeded synthetic transactions and references.

exact_*: the bit-exact sequence of a PCG32 stream. Rows take differing numbers
of draws, so the stream can't be dealt out: one task draws it in order, and
everything after (features, search, labels) is distributed again.

scalable_transactions: the same distributions from independent random columns,
for sizes where one task won't do. Not the same rows.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quintet.functions.scalars import round2
from quintet.operators import evaluate, knn, vectorize
from quintet.schema import MCC_RISK, TRANSACTION, Scale, one_line

REF_SEED, PAYLOAD_SEED = 42, 4242
LEGIT, FRAUD, BORDERLINE = "legit", "fraud", "borderline"

#: Fixed values of the workload: each profile's ranges; ends of whole-number ranges are exclusive.
PROFILES = {
    LEGIT: {"amount": (10, 500), "installments": (1, 4), "hour": (8, 21), "tx_count": (1, 6), "merchant_avg": (30, 500), "online": 0.3, "km_home": (0, 50), "minutes_back": (30, 720), "km_last": (0, 20), "codes": ("5411", "5812", "5912", "5311")},
    FRAUD: {"amount": (2000, 10000), "installments": (6, 13), "hour": (0, 7), "customer_avg": (50, 300), "tx_count": (8, 21), "merchant_avg": (20, 100), "online": 0.8, "km_home": (200, 1000), "minutes_back": (1, 10), "km_last": (200, 1000), "codes": ("7995", "7801", "7802")},
    BORDERLINE: {"amount": (400, 3000), "installments": (3, 8), "hour": (6, 23), "customer_avg": (100, 500), "tx_count": (4, 12), "merchant_avg": (50, 300), "online": 0.5, "km_home": (30, 400), "minutes_back": (5, 120), "km_last": (20, 300)},
}
DAYS, KNOWN, KNOWN_IDS, NEW_FRAUD, NEW_BORDERLINE = (10, 28), (2, 6), (1, 20), (50, 100), (30, 60)
M64, M32 = (1 << 64) - 1, (1 << 32) - 1


class Pcg32:
    """The PCG XSH-RR 64/32 generator."""

    def __init__(self, seed: int):
        self.inc = (seed << 1 | 1) & M64
        self.state = 0
        self.draw()
        self.state = (self.state + seed) & M64
        self.draw()

    def draw(self) -> int:
        old = self.state
        self.state = (old * 6364136223846793005 + self.inc) & M64
        word, turn = ((old >> 18 ^ old) >> 27) & M32, old >> 59
        return (word >> turn | word << (32 - turn & 31)) & M32

    def unit(self) -> float:
        return self.draw() / 4294967295.0

    def between(self, ends) -> float:
        return ends[0] + self.unit() * (ends[1] - ends[0])

    def whole(self, ends) -> int:
        return ends[0] + self.draw() % (ends[1] - ends[0])


def cents(x: float) -> float:
    """To 2 decimals, halves away from zero, as C's round() does it."""
    from math import floor

    return (floor(x * 100.0) if x * 100.0 - floor(x * 100.0) < 0.5 else floor(x * 100.0) + 1) / 100.0


def profile_of(rng: Pcg32, fraud_ratio: float) -> str:
    """A tenth of the fraud share is borderline."""
    v = rng.unit()
    return LEGIT if v < 1.0 - fraud_ratio else FRAUD if v < 1.0 - fraud_ratio * 0.10 else BORDERLINE


def transaction(rng: Pcg32, kind: str, all_codes: list[str]) -> dict:
    """One transaction; the order of draws is part of the format."""
    p = PROFILES[kind]
    ident = f"tx-{rng.draw()}"
    amount = cents(rng.between(p["amount"]))
    installments = rng.whole(p["installments"])
    day, hour, minute, second = rng.whole(DAYS), rng.whole(p["hour"]), rng.whole((0, 60)), rng.whole((0, 60))
    at = datetime(2026, 3, day, hour, minute, second, tzinfo=UTC)
    customer_avg = cents(rng.between(p.get("customer_avg") or (amount / 0.5, amount * 2.0)))
    tx_count = rng.whole(p["tx_count"])
    known = [f"MERC-{rng.whole(KNOWN_IDS):03d}" for _ in range(rng.whole(KNOWN))]
    if kind == LEGIT or kind == BORDERLINE and rng.unit() < 0.5:
        merchant = known[rng.whole((0, len(known)))]
    else:
        merchant = f"MERC-{rng.whole(NEW_FRAUD if kind == FRAUD else NEW_BORDERLINE):03d}"
    codes = p.get("codes", all_codes)
    mcc = codes[rng.whole((0, len(codes)))]
    merchant_avg = cents(rng.between(p["merchant_avg"]))
    online = rng.unit() < p["online"]
    present = not online and rng.unit() < 0.9
    km_home = rng.between(p["km_home"])
    last = None
    if not rng.unit() < 0.2:
        back = rng.whole(p["minutes_back"])
        last = {"timestamp": at - timedelta(minutes=back), "km_from_current": rng.between(p["km_last"])}
    return {
        "id": ident,
        "transaction": {"amount": amount, "installments": installments, "requested_at": at},
        "customer": {"avg_amount": customer_avg, "tx_count_24h": tx_count, "known_merchants": known},
        "merchant": {"id": merchant, "mcc": mcc, "avg_amount": merchant_avg},
        "terminal": {"is_online": online, "card_present": present, "km_from_home": km_home},
        "last_transaction": last,
    }


def stream(spark: SparkSession, seed: int, n: int) -> DataFrame:
    """(i, draw, unit) of the generator's first n numbers."""

    def run(batches):
        rng = Pcg32(seed)
        for _ in batches:
            pass
        for a in range(0, n, 10_000):
            draws = [rng.draw() for _ in range(a, min(n, a + 10_000))]
            yield pd.DataFrame({"i": range(a, a + len(draws)), "draw": draws, "unit": [d / 4294967295.0 for d in draws]})

    return spark.range(1).coalesce(1).mapInPandas(run, "i long, draw long, unit double")


def drawn(spark: SparkSession, n: int, fraud_ratio: float, seed: int, risk: dict[str, float], label: bool) -> DataFrame:
    """(idx, profile, label, transaction columns) in the order of the stream."""
    codes = [k for k, _ in vectorize.usable(risk)]

    def run(batches):
        rng, rows = Pcg32(seed), []
        for _ in batches:
            pass
        for i in range(n):
            kind = profile_of(rng, fraud_ratio)
            row = transaction(rng, kind, codes)
            said = kind
            if label and kind == BORDERLINE:
                said = FRAUD if rng.unit() < 0.5 else LEGIT
            rows.append({"idx": i, "profile": kind, "label": said, **row})
            if len(rows) == 10_000:
                yield pd.DataFrame(rows)
                rows = []
        if rows:
            yield pd.DataFrame(rows)

    return spark.range(1).coalesce(1).mapInPandas(run, "idx long, profile string, label string, " + one_line(TRANSACTION))


def exact_transactions(spark: SparkSession, n: int = 1000, fraud_ratio: float = 0.30, seed: int = PAYLOAD_SEED, risk: dict[str, float] | None = None) -> DataFrame:
    """idx and the transaction columns."""
    return drawn(spark, n, fraud_ratio, seed, MCC_RISK if risk is None else risk, False).drop("profile", "label")


def exact_references(spark: SparkSession, n: int = 200, fraud_ratio: float = 0.30, seed: int = REF_SEED, scale: Scale | None = None, risk: dict[str, float] | None = None) -> DataFrame:
    """(ref_idx, vector, label)"""
    risk = MCC_RISK if risk is None else risk
    rows = drawn(spark, n, fraud_ratio, seed, risk, True)
    return rows.select(F.col("idx").alias("ref_idx"), vectorize.vector(scale, risk).alias("vector"), "label")


def labelled(transactions: DataFrame, references: DataFrame, scale: Scale | None = None, risk: dict[str, float] | None = None) -> DataFrame:
    """transactions (idx, …) with expected_approved and expected_fraud_score by the references."""
    queries = transactions.select(F.col("idx").alias("q_id"), vectorize.vector(scale, risk).alias("vector"))
    votes = knn.vote(queries, knn.bucketed(queries, references))
    said = votes.select(F.col("q_id").alias("idx"), F.col("approved").alias("expected_approved"), F.col("fraud_score").alias("expected_fraud_score"))
    return transactions.join(said, "idx")


def stats(entries: DataFrame) -> DataFrame:
    return evaluate.label_stats(entries.select(F.col("expected_approved").alias("approved"), F.col("expected_fraud_score").alias("fraud_score")))


def scalable_transactions(spark: SparkSession, n: int, fraud_ratio: float = 0.30, seed: int = 1, partitions: int | None = None, risk: dict[str, float] | None = None) -> DataFrame:
    """idx, profile and the transaction columns, from columns of random numbers."""
    codes = [k for k, _ in vectorize.usable(MCC_RISK if risk is None else risk)]
    draws = iter(range(1000))
    u = lambda: F.rand(seed * 1000 + next(draws))
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    v = F.col("__v")
    rows = rows.select(F.col("id").alias("idx"), u().alias("__v")).withColumn("profile", F.when(v < 1 - fraud_ratio, LEGIT).when(v < 1 - fraud_ratio * 0.10, FRAUD).otherwise(BORDERLINE))

    def by_profile(make) -> Column:
        out = None
        for kind, p in PROFILES.items():
            value = make(kind, p)
            out = F.when(F.col("profile") == kind, value) if out is None else out.when(F.col("profile") == kind, value)
        return out

    def between(name: str) -> Column:
        x = u()
        return by_profile(lambda kind, p: F.lit(float(p[name][0])) + x * float(p[name][1] - p[name][0]))

    def whole(name: str) -> Column:
        x = u()
        return by_profile(lambda kind, p: (F.lit(p[name][0]) + F.floor(x * (p[name][1] - p[name][0]))).cast("int"))

    span = lambda ends: (F.lit(ends[0]) + F.floor(u() * (ends[1] - ends[0]))).cast("int")
    rows = rows.withColumn("amount", round2(between("amount"))).withColumn("at", F.make_timestamp(F.lit(2026), F.lit(3), span(DAYS), whole("hour"), span((0, 60)), span((0, 60)).cast("decimal(8,6)"), F.lit("UTC")))
    x = u()
    rows = rows.withColumn("customer_avg", by_profile(lambda kind, p: round2(F.lit(float(p["customer_avg"][0])) + x * float(p["customer_avg"][1] - p["customer_avg"][0])) if "customer_avg" in p else F.col("amount") * 2.0))
    merc = lambda ends: F.format_string("MERC-%03d", span(ends))
    rows = rows.withColumn("known", F.slice(F.array(*[merc(KNOWN_IDS) for _ in range(KNOWN[1] - 1)]), F.lit(1), span(KNOWN)))
    own = F.get("known", F.least(F.floor(u() * F.size("known")).cast("int"), F.size("known") - 1))
    side = u()
    rows = rows.withColumn("merchant_id", F.when(F.col("profile") == LEGIT, own).when(F.col("profile") == FRAUD, merc(NEW_FRAUD)).otherwise(F.when(side < 0.5, own).otherwise(merc(NEW_BORDERLINE))))
    pick = u()
    rows = rows.withColumn("mcc", by_profile(lambda kind, p: F.get(F.array(*map(F.lit, p.get("codes", codes))), F.floor(pick * len(p.get("codes", codes))).cast("int"))))
    online = u()
    rows = rows.withColumn("online", by_profile(lambda kind, p: online < p["online"])).withColumn("present", ~F.col("online") & (u() < 0.9))
    rows = rows.withColumn("has_last", u() >= 0.2).withColumn("back", whole("minutes_back")).withColumn("km_last", between("km_last"))
    return rows.select(
        "idx", "profile", F.concat(F.lit("tx-"), F.col("idx").cast("string")).alias("id"),
        F.struct("amount", whole("installments").alias("installments"), F.col("at").alias("requested_at")).alias("transaction"),
        F.struct(F.col("customer_avg").alias("avg_amount"), whole("tx_count").alias("tx_count_24h"), F.col("known").alias("known_merchants")).alias("customer"),
        F.struct(F.col("merchant_id").alias("id"), "mcc", round2(between("merchant_avg")).alias("avg_amount")).alias("merchant"),
        F.struct(F.col("online").alias("is_online"), F.col("present").alias("card_present"), between("km_home").alias("km_from_home")).alias("terminal"),
        F.when(F.col("has_last"), F.struct(F.timestamp_seconds(F.unix_timestamp("at") - F.col("back") * 60).alias("timestamp"), F.col("km_last").alias("km_from_current"))).alias("last_transaction"),
    )
