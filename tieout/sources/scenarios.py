"""Fifteen situations worked out by hand, each with what must come of it; no two share a day, an amount or an id."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from tieout.schema import ENTRY, as_entries

START = dt.date(2025, 1, 1)
#: Days between two situations: none is in another's windows.
APART = 100


@dataclass
class Scenario:
    """``rows``: (source, id, amount, day, more columns); ``together``: ids that end in one group, with its status; ``raised``: category by id."""

    rows: list[tuple[str, str, int, int, dict]]
    together: dict[tuple[str, ...], str] = field(default_factory=dict)
    raised: dict[str, str] = field(default_factory=dict)


def _sale(gross: int, fee: int = 0, tax: int = 0, tds: int | None = None, less: int = 0, paid: int = 2, more: list | None = None, name: str = "") -> list:
    """A sale, its payout and its credit."""
    net = gross - less - fee - tax - (tds or 0)
    utr = {"reference": f"utr{name}"}
    return [("payment", f"pay{name}", gross, 0, {"reference": f"ord{name}"}), ("settlement", f"set{name}", net, paid, {**utr, "fee": fee, "tax": tax, "tds": tds}), ("bank", f"bnk{name}", net, paid, utr), *(more or [])]


def _taken(source: str, id_: str, amount: int, day: int, of: str = "pay", **more) -> tuple:
    return (source, id_, amount, day, {"reference": id_, "related": of, **more})


_ALL = ("bnk", "pay", "set")

SCENARIOS: dict[str, Scenario] = {
    "card": Scenario(_sale(250_000, 5_000, 900, more=[("ledger", "led", 250_000, 0, {"reference": "ord"})]), {("bnk", "led", "pay", "set"): "complete"}),
    "no_fee": Scenario(_sale(81_000), {_ALL: "complete"}),
    "own_rate": Scenario(_sale(300_000, 4_200, 756), {_ALL: "complete"}),
    "foreign_card": Scenario(_sale(612_000, 18_360, 3_305), {_ALL: "complete"}),
    "tax_withheld": Scenario(_sale(1_000_000, 20_000, 3_600, 10_000), {_ALL: "complete"}),
    "part_refund": Scenario(_sale(90_000, 1_260, 227, less=27_000, more=[_taken("refund", "rf", 27_000, 1)]), {("bnk", "pay", "rf", "set"): "complete"}),
    "two_refunds": Scenario(_sale(120_000, less=50_500, more=[_taken("refund", "rf1", 20_000, 1), _taken("refund", "rf2", 30_500, 1)]), {("bnk", "pay", "rf1", "rf2", "set"): "complete"}),
    "all_refunded": Scenario([("payment", "pay", 45_300, 0, {"reference": "ord"}), ("ledger", "led", 45_300, 0, {"reference": "ord"}), _taken("refund", "rf", 45_300, 1)], {("led", "pay", "rf"): "fully_refunded"}),
    "refund_after_payout": Scenario(_sale(70_700, more=[_taken("refund", "rf", 10_000, 20)]), {("bnk", "pay", "rf", "set"): "complete"}),
    "lost_dispute": Scenario(_sale(52_400, less=20_100, more=[_taken("chargeback", "cb", 20_100, 1, dispute="lost")]), {("bnk", "cb", "pay", "set"): "complete"}),
    "open_dispute": Scenario(_sale(58_900, more=[_taken("chargeback", "cb", 21_300, 1, dispute="open")]), {("bnk", "cb", "pay", "set"): "complete"}),
    "batch": Scenario(
        [*(("payment", f"pay{i}", a, 0, {"reference": f"ord{i}"}) for i, a in enumerate((11_100, 22_300, 33_700))), ("settlement", "set", 67_100, 2, {"reference": "utr"}), ("bank", "bnk", 67_100, 2, {"reference": "utr"})],
        {("bnk", "pay0", "pay1", "pay2", "set"): "complete"},
    ),
    "one_credit": Scenario(
        [x for name, gross in (("1", 41_900), ("2", 53_600)) for x in _sale(gross, name=name)[:2]] + [("bank", "bnk", 95_500, 2, {})],
        {("bnk", "pay1", "pay2", "set1", "set2"): "complete"},
    ),
    "two_currencies": Scenario(
        [(s, f"{i}_{c}", a, d, {**m, "reference": f"{m['reference']}_{c}", "currency": c}) for c in ("INR", "USD") for s, i, a, d, m in _sale(77_700)],
        {tuple(f"{i}_{c}" for i in _ALL): "complete" for c in ("INR", "USD")},
    ),
    "next_month": Scenario(
        _sale(64_800, paid=33, more=[_taken("refund", "rf", 900, 1, of="nobody"), ("bank", "charge", -1_180, 5, {})]), {_ALL: "complete"}, {"rf": "orphan_refund", "charge": "fee_mismatch"}
    ),
}


def entries(spark: SparkSession, name: str) -> DataFrame:
    """SC13: one situation's entries; ids and references are its own."""
    at = list(SCENARIOS).index(name)
    own = lambda s: f"{name}_{s}" if s else s
    names = [f.split()[0] for f in ENTRY.split(", ")]
    rows = []
    for i, (source, id_, amount, day, more) in enumerate(SCENARIOS[name].rows):
        row = {"fee": 0, "tax": 0, "currency": "INR", **more, "id": own(id_), "source": source, "amount": amount, "value_date": START + dt.timedelta(at * APART + day), "fee_reported": source == "settlement", "ord": at * 1000 + i}
        row |= {c: own(row.get(c)) for c in ("reference", "related")}
        rows.append(tuple(row.get(n) for n in names))
    return as_entries(spark.createDataFrame(rows, ENTRY))


def combined(spark: SparkSession) -> DataFrame:
    """SO2: all situations as one batch."""
    return reduce(DataFrame.unionByName, [entries(spark, n) for n in SCENARIOS])


def expected() -> tuple[dict[frozenset, str], dict[str, str]]:
    """What :func:`combined` must give: status by group, category by exception."""
    groups = {frozenset(f"{n}_{i}" for i in ids): status for n, s in SCENARIOS.items() for ids, status in s.together.items()}
    return groups, {f"{n}_{i}": c for n, s in SCENARIOS.items() for i, c in s.raised.items()}
