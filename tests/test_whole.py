"""Queries that once passed over a part of their input: the whole of it on inputs that the cut left out."""

import datetime as dt
import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tieout.conf import Settings
from tieout.plans.queries import QUERIES
from tieout.schema import SOURCES, as_entries

D = dt.date(2026, 1, 1)

ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"


def test_pairs_of_crowded_windows_are_scored(spark, tmp_path):
    """60 orders of one amount: 120 entries in each other's windows, and as two of them in another currency."""
    rows = [(k, 1, "F", 5000.0, dt.datetime(2000, 1, 1), "2-HIGH") for k in range(60)] + [(k, 7, "F", 5000.0, dt.datetime(2000, 1, 1), "2-HIGH") for k in (60, 61)]
    spark.createDataFrame(rows, ORDER).write.parquet(f"{tmp_path}/orders.parquet")
    got = [tuple(r) for r in QUERIES["pair_scores"](spark, str(tmp_path)).select("a_id", "b_id").collect()]
    want = {frozenset((f"b{i}", f"l{j}")) for n in (range(60), range(60, 62)) for i in n for j in n}
    assert set(map(frozenset, got)) == want and len(got) == len(want) == 3604


def test_a_run_works_out_what_is_asked_for(spark, monkeypatch):
    """Refusals need no bank link, counts no category and no group."""
    import pytest

    from tieout.operators import exceptions, groups, settlement
    from tieout.plans.engine import Result

    def never(*_, **__):
        raise AssertionError("not asked for")

    kind = "id string, source string, amount long, value_date date, reference string, ord long"
    rows = [("p1", "payment", 500, D, "A", 1), ("p2", "payment", 500, D, "B", 2), ("s1", "settlement", 500, D + dt.timedelta(2), "U", 3), ("b1", "bank", 77, D, None, 4)]
    batch = as_entries(spark.createDataFrame(rows, kind).withColumns({"currency": F.lit("INR"), "fee": F.lit(0), "tax": F.lit(0)}))
    result = Result(batch)
    monkeypatch.setattr(groups, "groups", never)
    monkeypatch.setattr(exceptions, "classify_residual", never)
    monkeypatch.setattr(settlement, "link_banks", never)
    assert [(r.rule, r.inputs) for r in result.refused.collect()] == [("ambiguous-single@v1", ["p1", "p2", "s1"])]
    with pytest.raises(AssertionError):
        _ = result.exceptions
    monkeypatch.undo()
    monkeypatch.setattr(groups, "groups", never)
    monkeypatch.setattr(exceptions, "classify_residual", never)
    assert tuple(result.metrics().select("entries", "exceptions", "matched").first()) == (4, 4, 0)
    monkeypatch.undo()
    assert result.exceptions.count() == 4 and result.conserved()


def test_sale_units_equal_units(spark):
    from tieout.operators.units import has, sale_units, units

    rng = random.Random(8)
    kind = "source string, amount long, value_date date, dispute string, ord long, comp long, currency string, id string, reference string"
    rows = [(rng.choice(SOURCES), rng.choice([0, rng.randint(1, 900)]), D + dt.timedelta(rng.choice([0, 0, 0, 1, 5])), rng.choice([None, "lost", "open"]), i, rng.randrange(150), "INR", f"e{i}", "r") for i in range(500)]
    rows = [(*r[:6], "USD" if r[5] % 3 else "INR", *r[7:]) for r in rows]
    held = spark.createDataFrame(rows, kind)
    shape = lambda df: sorted(tuple(r) for r in df.select("comp", "currency", "ord", "base_gross", "gross", F.array_sort("events").cast("string"), F.col("pay_dates").cast("string"), F.array_sort("dates").cast("string")).collect())
    got, want = sale_units(held), units(held)
    assert shape(got.where("sold")) == shape(want.where(has("payment") & ~has("settlement"))) != []
    assert {r.comp for r in got.where("not sold").collect()} == {r.comp for r in want.where(has("settlement") & ~has("payment")).collect()} != set()


def test_every_option_against_brute_force(monkeypatch):
    from tieout.operators import solver

    rng = random.Random(14)
    for i in range(300):
        monkeypatch.setattr(solver, "HELD", rng.choice([0, 30, 10**6]))
        n = rng.randint(2, 13)
        pool = [(u, rng.randint(1, rng.choice([9, 60, 1000])), sorted(rng.sample(range(3), rng.randint(1, 2)))) for u in range(n)]
        target, most = sum(a for _, a, _ in rng.sample(pool, rng.randint(2, min(n, 6)))) + rng.choice([0, 0, 1, 2, 4]), rng.choice([2, 4, 6])
        days = [[(a, u) for u, a, at in pool if d in at] for d in range(3)]
        want = {off: {frozenset(u for _, u in c) for d in days for k in range(2, most + 1) for c in itertools.combinations(d, k) if abs(sum(a for a, _ in c) - target) <= off} for off in (0, 2)}
        held = [(np.array([u for _, u in sorted(d)], np.int64), np.array([a for a, _ in sorted(d)], np.int64), {}) for d in days]
        got, exact, whole = solver.every_option(held, target, most, 2, 10**9)
        assert whole and set(map(frozenset, got)) == (want[0] or want[2]) and len(got) == len(set(map(frozenset, got))) and exact == bool(want[0])
        few, _, whole = solver.every_option(held, target, most, 2, 3)
        assert whole == (len(got) <= 3) and len(few) == min(len(got), 4) and set(map(frozenset, few)) <= set(map(frozenset, got))


def test_all_subsets_in_turns(spark):
    """Windows of few amounts, so that options abound and are struck: the turns over all options of each anchor."""
    from tieout.operators.solver import assign_all, every_option, propagate

    rng = random.Random(15)
    units, anchors, options = [], [], {}
    for w in range(40):
        start = D + dt.timedelta(10 * w)
        own = [(100 * w + u, rng.randint(1, rng.choice([2, 3, 12, 300])), start) for u in range(rng.randint(3, 9))]
        asked = [(10_000 + 100 * w + a, sum(v for _, v, _ in rng.sample(own, rng.randint(2, 3)))) for a in range(5)]
        units += [(u, "INR", start, v, [start]) for u, v, _ in own]
        anchors += [(a, "INR", start, t) for a, t in asked]
        day = sorted((v, u) for u, v, _ in own)
        held = [(np.array([u for _, u in day], np.int64), np.array([v for v, _ in day], np.int64), {})]
        options |= {a: every_option(held, t, 4, 2, 10**9)[0] for a, t in asked}
    want = propagate({a: o for a, o in options.items() if o})[0]
    sent = spark.createDataFrame(anchors, "anchor long, currency string, start date, target long"), spark.createDataFrame(units, "unit long, currency string, start date, value long, days array<date>")
    assert max(map(len, options.values())) > 8
    for enough in (1, 8):
        got = {}
        for r in assign_all(*sent, 4, 2, enough).where("decided").collect():
            got.setdefault(r.anchor, set()).add(r.unit)
        assert got == {a: set(o) for a, o in want.items()} and len(got) > 20


def test_subsets_of_large_pools(spark):
    """A payout of two sales among 72 that it exceeds: more than 60 gave no subset."""
    from tieout.operators.settlement import link_settlements

    rows = [(f"p{i}", "payment", 10_000 + 1700 * i, D, i) for i in range(70)] + [("p70", "payment", 5_000_000, D, 70), ("p71", "payment", 5_000_100, D, 71), ("s", "settlement", 10_000_100, D + dt.timedelta(2), 1000)]
    batch = as_entries(spark.createDataFrame(rows, "id string, source string, amount long, value_date date, ord long").withColumns({"reference": F.col("id"), "currency": F.lit("INR"), "fee": F.lit(0), "tax": F.lit(0)}))
    batch = batch.withColumns({"comp": F.col("ord"), "ref": F.col("reference")})
    pairs = lambda **limits: {(r.anchor, r.unit) for r in link_settlements(batch, Settings(**limits))[0].collect()}
    assert pairs() == set() and pairs(pool=0) == {(1000, 70), (1000, 71)}


def test_row_checks_shuffle_once(spark):
    from tieout.sources import ingest

    rows = [("p1", "5.00", "2026-01-01", "r1"), ("p1", "6.00", "2026-01-01", "r1"), ("", "5.00", "2026-01-01", "r1"), ("", "5.00", "2026-01-01", "R1 "), ("", "5.00", "2026-01-01", ""), (None, "5.00", "2026-01-01", None), ("p2", "x", "2026-01-01", ""), ("p3", "5", "never", ""), ("ip1", "5", "2026-01-01", "")]
    assessed = ingest.prepare(spark.createDataFrame(rows, "Id string, Amount string, Date string, Ref string"), "ledger")
    got = [(r.accepted, [(i.field, i.problem) for i in r.issues]) for r in assessed.orderBy("_row").collect()]
    again = [("reference", "exported twice")]
    assert [g for g in got if g[0]] == [(True, []), (True, []), (True, again), (True, []), (True, []), (True, [])]
    assert [g[1][0][1].split()[0] for g in got if not g[0]] == ["repeats", "not", "not"]
    planned = lambda df: [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in line]
    assert len(planned(assessed)) == 1
    assert len(planned(assessed.where("accepted").select("_row"))) == 1
