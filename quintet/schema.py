"""Schemas of the data model, and the constants that features are scaled by."""

from __future__ import annotations

from dataclasses import asdict, dataclass

DIMS = 14
K = 5
THRESHOLD = 0.6

TRANSACTION = """
    id string,
    transaction struct<amount:double,installments:int,requested_at:timestamp>,
    customer struct<avg_amount:double,tx_count_24h:int,known_merchants:array<string>>,
    merchant struct<id:string,mcc:string,avg_amount:double>,
    terminal struct<is_online:boolean,card_present:boolean,km_from_home:double>,
    last_transaction struct<timestamp:timestamp,km_from_current:double>
"""
REFERENCE = "ref_idx bigint, vector array<double>, label string"
RESPONSE = "approved boolean, fraud_score double"
STATS = "total bigint, fraud_count bigint, legit_count bigint, fraud_rate double, legit_rate double, edge_case_count bigint, edge_case_rate double"


def one_line(schema: str) -> str:
    return " ".join(schema.split())


def struct(schema: str) -> str:
    """A DDL column list as a struct type."""
    return f"struct<{one_line(schema)}>"


#: The columns of TRANSACTION.
FIELDS = ("id", "transaction", "customer", "merchant", "terminal", "last_transaction")
TEST_DATA = f"references_checksum_sha256 string, stats {struct(STATS)}, entries array<struct<request:{struct(TRANSACTION)},expected_approved:boolean,expected_fraud_score:double>>"


@dataclass(frozen=True)
class Scale:
    """Divisors of the features. Fixed values of the workload; all are parameters."""

    max_amount: float = 10000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1440.0
    max_km: float = 1000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10000.0

    def to_dict(self) -> dict[str, float]:
        return asdict(self)


#: Risk by merchant category code. Fixed values of the workload.
MCC_RISK = {
    "5411": 0.15,
    "5812": 0.30,
    "5912": 0.20,
    "5944": 0.45,
    "7801": 0.80,
    "7802": 0.75,
    "7995": 0.85,
    "4511": 0.35,
    "5311": 0.25,
    "5999": 0.50,
}
DEFAULT_RISK = 0.5
#: A risk map holds this many entries, of codes this long; later ones aren't seen.
MOST_CODES, CODE_CHARS = 32, 7
