"""The entry schema and the fixed values of the data contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
SOURCES = ["payment", "settlement", "bank", "ledger", "refund", "chargeback"]
DEDUCTIONS = ["refund", "chargeback"]
DISPUTES = ["open", "under_review", "won", "lost", "accepted"]
CATEGORIES = [
    "missing_in_bank", "missing_in_ledger", "amount_mismatch", "duplicate", "split_settlement", "merged_payout", "fee_mismatch",
    "payout_in_transit", "orphan_refund", "orphan_chargeback", "over_refunded", "fx_or_adjustment", "currency_mismatch", "unknown",
]
STAGES = ["deterministic", "structural", "heuristic", "agent"]
STATUSES = [
    "complete", "awaiting_settlement", "awaiting_payout", "payout_overdue", "unbooked_payout", "ambiguous_split", "fully_refunded", "partial",
]

ENTRY = (
    "id string, source string, amount bigint, value_date date, currency string, reference string, narration string, method string,"
    " related string, fee bigint, tax bigint, tds bigint, fee_reported boolean, dispute string, ord bigint"
)


def as_entries(df: DataFrame) -> DataFrame:
    """``df`` with exactly the entry columns, absent ones null."""
    columns = []
    for field in ENTRY.split(", "):
        name, kind = field.split()
        columns.append((F.col(name) if name in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(columns)
