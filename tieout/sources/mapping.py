"""Columns of an export, found from its headings: metadata only, so this runs on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import groupby
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Headings of each field, best first, and parts of words that point to it.
FIELDS: dict[str, tuple[list[str], list[str]]] = {
    "id": (["id", "txn id", "transaction id", "reference no", "ref no", "cheque no", "payment id", "entry id", "sl no", "serial"], ["transactionid", "voucher"]),
    "date": (["date", "value date", "transaction date", "txn date", "posting date", "created at", "settled at", "booking date", "value dt", "tran date"], ["date", "dt"]),
    "amount": (["amount", "amt", "transaction amount", "txn amount", "amount inr", "gross amount", "gross"], ["amount", "amt"]),
    "debit": (["debit", "withdrawal", "withdrawal amt", "withdrawals", "dr", "debit amount", "paid out", "outflow"], ["withdraw", "debit", "outflow"]),
    "credit": (["credit", "deposit", "deposit amt", "deposits", "cr", "credit amount", "paid in", "inflow"], ["deposit", "credit", "inflow"]),
    "narration": (["narration", "description", "particulars", "remarks", "details", "transaction remarks", "memo", "note", "transaction details"], ["narrat", "descri", "particular", "remark", "detail", "memo"]),
    "reference": (["utr", "ref", "reference", "rrn", "external ref", "order id", "utr no", "utr number", "chq ref no", "chq no", "instrument no"], ["utr", "rrn", "ref", "order"]),
    "currency": (["currency", "ccy", "curr", "currency code"], ["currenc", "ccy"]),
    "balance": (["balance", "closing balance", "running balance", "bal"], ["balance", "bal"]),
    "fees": (["fee", "fees", "commission", "mdr", "charges", "gateway fee"], ["fee", "commission", "mdr", "charge"]),
    "tax": (["tax", "gst", "gst on fee", "service tax", "igst", "cgst"], ["gst", "tax"]),
    "tds": (["tds", "tds amount", "withholding", "withholding tax"], ["tds", "withhold"]),
    "status": (["status", "state", "txn status", "payment status", "dispute status"], ["status", "state"]),
    "method": (["method", "payment method", "mode", "payment mode", "instrument", "channel"], ["method", "mode", "instrument", "channel"]),
    "payment_id": (["payment id", "parent payment", "original payment", "against payment", "linked payment"], ["paymentid", "parent"]),
    "type": (["type", "dr cr", "drcr", "cr dr", "transaction type", "txn type"], ["drcr", "type"]),
}
REQUIRED = {"payment": ["amount", "date"], "settlement": ["amount", "date"], "bank": ["date"], "ledger": ["amount", "date"], "refund": ["amount", "date"], "chargeback": ["amount", "date"]}


class MappingError(ValueError):
    """A file whose columns can't be told without guessing."""


@dataclass
class Mapping:
    source: str
    columns: dict[str, str] = field(default_factory=dict)
    ambiguous: dict[str, list[str]] = field(default_factory=dict)
    missing: list[str] = field(default_factory=list)

    @property
    def usable(self) -> bool:
        return not self.ambiguous and not self.missing

    def explain(self) -> list[str]:
        """MP6."""
        lines = [f"{f} <- {c}" for f, c in self.columns.items()]
        lines += [f"{f}: could be any of {', '.join(cs)}" for f, cs in self.ambiguous.items()]
        return lines + [f"{f}: no column found" for f in self.missing]


def canonical(heading: str) -> str:
    """MP1."""
    return re.sub(r"[^a-z0-9]+", " ", heading.lower()).strip()


class Edge(NamedTuple):
    """A column that may be a field's: the larger ``score`` and then the smaller ``rank`` fit better."""

    field: str
    column: int
    score: int
    rank: int


def edges_of(headings: list[str]) -> list[Edge]:
    """MP2, MP3: the best claim of each field on each column; the surest fields come first, and of a field the best columns."""
    tests = {100: lambda h, n: h == n, 70: lambda h, n: h.startswith(f"{n} ") or n.startswith(f"{h} "), 40: lambda h, n: n in h}
    found = []
    for name, (names, stems) in FIELDS.items():
        for column, heading in enumerate(map(canonical, headings)):
            claims = [(score, -rank) for score, fits in tests.items() for rank, n in enumerate(stems if score == 40 else names) if heading and fits(heading, n)]
            if claims:
                score, rank = max(claims)
                found.append(Edge(name, column, score, -rank))
    surest: dict[str, int] = {}
    for e in found:
        surest[e.field] = max(e.score, surest.get(e.field, 0))
    return sorted(found, key=lambda e: (-surest[e.field], list(FIELDS).index(e.field), -e.score, e.rank, e.column))


def _rivals(claims: list[Edge]) -> list[Edge]:
    """MP4: an amount's best claims, or a date's where two are by one name, can't be told apart if they tie; the claims that do."""
    top = [e for e in claims if e.score == claims[0].score >= 70]
    alike = len(top) > 1 and (claims[0].field == "amount" or claims[0].field == "date" and top[0].rank == top[1].rank)
    return top if alike else []


def detect(headings: list[str], source: str) -> Mapping:
    """MP3 to MP5: one pass over the edges gives each field its best free column; rivals are refused, not guessed."""
    out, free = Mapping(source), set(range(len(headings)))
    for name, claims in groupby(edges_of(headings), key=lambda e: e.field):
        open_ = [e for e in claims if e.column in free]
        if open_ and (rivals := _rivals(open_)):
            out.ambiguous[name] = [headings[e.column] for e in rivals]
        elif open_:
            free.discard(open_[0].column)
            out.columns[name] = headings[open_[0].column]
    told = {*out.columns, *out.ambiguous}
    out.missing = [f for f in REQUIRED[source] if f not in told]
    if source == "bank" and told.isdisjoint(("amount", "debit", "credit")):
        out.missing.append("amount")
    return out


#: Column of what is wrong with a row as a whole.
CORRUPT = "_corrupt"


def clean_number(c: Column) -> Column:
    """MP10: major units of a text with separators, signs or parentheses; blank and dashes are 0."""
    s = F.trim(F.regexp_replace(c, "[,₹$]", ""))
    negative = s.startswith("(") & s.endswith(")")
    value = F.coalesce(F.regexp_replace(s, r"^\(|\)$", "").try_cast("double"), F.lit(0.0))
    return F.when(negative, -value).otherwise(value)


def apply(df: DataFrame, mapping: Mapping) -> DataFrame:
    """MP7 to MP9: text columns by field, ``amount_major`` where debit and credit were folded, ``raw``, and ``_row`` in file order."""
    text = {f: F.col(f"`{c}`").cast("string") for f, c in mapping.columns.items()}
    none = F.lit(None).cast("string")
    raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("raw")
    corrupt = (F.col(CORRUPT) if CORRUPT in df.columns else none).alias(CORRUPT)
    kind, major = text.get("type", none), F.lit(None).cast("double")
    if "amount" not in text and {"debit", "credit"} & set(text):
        debit, credit = (clean_number(F.coalesce(text.get(k, none), F.lit(""))) for k in ("debit", "credit"))
        major = F.when(credit != 0, credit).when(debit != 0, -F.abs(debit)).otherwise(0.0)
        kind = F.when(credit != 0, "credit").when(debit != 0, "debit")
    names = ["id", "amount", "date", "reference", "narration", "currency", "fees", "tax", "tds", "status", "method", "payment_id"]
    return df.select(*[text.get(f, none).alias(f) for f in names], kind.alias("type"), major.alias("amount_major"), raw, corrupt, F.monotonically_increasing_id().alias("_row"))
