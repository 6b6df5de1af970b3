"""The fifteen situations, as one batch and one of them alone; arithmetic of the settlement equation over a grid."""

import itertools

from pyspark.sql import functions as F

from tieout.functions import fees
from tieout.plans.engine import reconcile
from tieout.sources import scenarios


def outcome(result):
    groups = {frozenset(r.entry_ids): r.status for r in result.groups.collect()}
    return groups, {r.id: r.category for r in result.exceptions.collect()}


def test_all_situations_at_once(spark):
    assert len(scenarios.SCENARIOS) == 15
    batch = scenarios.combined(spark)
    result = reconcile(batch)
    assert outcome(result) == scenarios.expected()
    assert result.conserved() and result.fingerprint().first() == reconcile(batch).fingerprint().first()
    rules = {r.first_ord // 1000: r.rules for r in result.groups.collect()}
    named = dict(zip(scenarios.SCENARIOS, range(15)))
    assert "late-payout@v1" in rules[named["refund_after_payout"]] and "late-payout@v1" in rules[named["next_month"]]
    assert "split-settlement@v1" in rules[named["batch"]] and "merged-bank-credit@v1" in rules[named["one_credit"]]


def test_one_situation_alone(spark):
    groups, raised = outcome(reconcile(scenarios.entries(spark, "batch")))
    assert list(groups.values()) == ["complete"] and not raised


def test_settlement_equation_over_a_grid(spark):
    half = lambda n, d: (2 * abs(n) + d) // (2 * d)
    rows, want = [], {}
    for i, (gross, (bps, flat), tds, taken) in enumerate(itertools.product([1, 99, 10_000, 123_457, 999_999, 5_000_000, 10**12], [(0, 0), (140, 0), (180, 0), (200, 0), (300, 0), (200, 300)], [0, 10, 100], [(0, 0), (1, 0), (0, 7), (5, 9)])):
        fee = half(gross * bps, 10_000) + flat
        want[i] = gross - fee - half(fee * 1800, 10_000) - half(gross * tds, 10_000) - sum(taken)
        rows.append((i, gross, f"m{bps}_{flat}", tds, *taken))
    assert len(rows) == 504
    sales = spark.createDataFrame(rows, "i long, gross long, method string, tds long, refunds long, chargebacks long").selectExpr("*", "'INR' currency", "cast(null as long) reported_fee", "cast(null as long) reported_tax", "cast(null as long) reported_tds")
    card = spark.createDataFrame([(f"m{b}_{f}", b, f, 1800, "x") for b, f in [(0, 0), (140, 0), (180, 0), (200, 0), (300, 0), (200, 300)]], "method string, percent_bps long, fixed_minor long, tax_bps long, label string")
    got = {}
    for tds in (0, 10, 100):
        got |= {r.i: r.net for r in fees.breakdown(fees.priced(sales.where(F.col("tds") == tds).drop("tds"), card, tds_bps=tds)).collect()}
    assert got == want
