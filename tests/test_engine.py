"""Hand-made batches through the whole engine, and the parts that need no tables."""

import datetime as dt
import itertools
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tieout.conf import Settings
from tieout.functions import fees
from tieout.operators import reference, resolver, settlement, solver
from tieout.operators.settlement import link_settlements
from tieout.operators.solver import _sweep, contested_links, propagate, subset_options
from tieout.operators.worklist import Worklist
from tieout.plans.engine import reconcile
from tieout.schema import ENTRY, as_entries
from tieout.sources import ingest, mapping

D = dt.date(2026, 1, 1)


def entries(spark, rows):
    names = ["id", "source", "amount", "value_date", "reference", "narration", "related"]
    full = [(*r, *[None] * (len(names) - len(r)), i, "INR", 0, 0) for i, r in enumerate(rows)]
    kind = "id string, source string, amount long, value_date date, reference string, narration string, related string, ord long, currency string, fee long, tax long"
    return as_entries(spark.createDataFrame(full, kind))


def test_a_month_in_small(spark):
    day = lambda n: D + dt.timedelta(n)
    batch = entries(spark, [
        ("pay_1", "payment", 10000, D, "ORD1"), ("set_1", "settlement", 10000, day(2), "UTR1"), ("bnk_1", "bank", 10000, day(2), "UTR1"), ("led_1", "ledger", 10000, D, "ORD1"),
        ("pay_2", "payment", 5000, D, "ORD2"), ("led_2", "ledger", 5000, D, "ORD2"), ("led_2b", "ledger", 5000, D, "ORD2"),
        ("rf_9", "refund", 700, D, "rf_9", None, "nobody"), ("bnk_8", "bank", 123456, day(9), None, "acme invoice"), ("led_8", "ledger", 123456, day(8), None, "invoice acme"),
        ("bnk_7", "bank", 999999, day(9), None, "unknown"),
    ])
    result = reconcile(batch, Settings())
    groups = {frozenset(r.entry_ids): (r.status, r.stage) for r in result.groups.collect()}
    assert groups[frozenset({"pay_1", "set_1", "bnk_1", "led_1"})] == ("complete", "structural")
    assert groups[frozenset({"bnk_8", "led_8"})] == ("complete", "heuristic")
    assert groups[frozenset({"pay_2", "led_2"})][0] == "payout_overdue"
    assert {r.id: r.category for r in result.exceptions.collect()} == {"rf_9": "orphan_refund", "led_2b": "duplicate", "bnk_7": "missing_in_ledger"}
    assert result.conserved()


def test_an_empty_batch(spark):
    result = reconcile(spark.createDataFrame([], ENTRY))
    assert result.groups.count() == result.exceptions.count() == 0


def test_sweep_and_subsets():
    assert dict(_sweep([1, 2, 2, 3], [7, 7, 8, 8], [True] * 4, True)) == {1: 7, 2: 8}
    pool = [(i, a, [D]) for i, a in enumerate([100, 200, 300, 300])]
    assert set(subset_options(pool, 300, 3)) == {(0, 1)} and len(subset_options(pool, 600, 3)) == 3


def plain_sweep(rows, repeat):
    """Anchors in order, each linked when it sees exactly one open unit, in passes until one links nothing."""
    wishes, taken, links, again = {}, set(), {}, True
    for a, u, e in rows:
        wishes.setdefault(a, (set(), set()))[0 if e else 1].add(u)
    while again:
        again = False
        for anchor in sorted(wishes.keys() - links.keys()):
            exact, near = (w - taken for w in wishes[anchor])
            open_ = exact or near
            if len(open_) == 1:
                links[anchor] = open_.pop()
                taken.add(links[anchor])
                again = repeat
    return links


def random_candidates(rng, anchors, units):
    return [(a, u, rng.random() < 0.5) for a in range(anchors) for u in rng.sample(range(units), rng.randint(1, 3))]


def test_sweep_against_passes():
    rng = random.Random(3)
    for _ in range(2000):
        rows = random_candidates(rng, rng.randint(1, 8), 8)
        for repeat in (True, False):
            assert dict(_sweep(*zip(*rows), repeat)) == plain_sweep(rows, repeat)


@pytest.mark.parametrize("rounds", [24, 2])  # the second leaves most to whole components
@pytest.mark.parametrize("repeat", [True, False])
def test_contested_links_against_passes(spark, repeat, rounds):
    rng = random.Random(8)
    rows, want = [], {}
    for g in range(60):  # graphs of their own numbers, most of them one component
        mine = [(a + 1000 * g, u + 1000 * g, e) for a, u, e in random_candidates(rng, rng.randint(2, 40), 40)]
        rows += mine
        want |= plain_sweep(mine, repeat)
    got = contested_links(spark.createDataFrame(rows, "anchor long, unit long, exact boolean"), repeat, rounds).collect()
    assert dict(map(tuple, got)) == want and len(got) == len(want)


def test_a_long_chain_of_anchors_is_no_component_of_one_task(spark):
    """Amounts two apart chain all anchors together, but each has an exact unit: two rounds."""
    n = 3000
    rows = [(a, u, a == u) for a in range(n) for u in (a - 1, a, a + 1) if 0 <= u < n]
    chosen, settled = solver._choices(spark.createDataFrame(rows, "anchor long, unit long, exact boolean"), 3)
    assert settled and chosen.where("anchor = unit").count() == n


def test_mapping_refuses_to_guess():
    good = mapping.detect(["Txn Date", "Value Date", "Narration", "Withdrawal Amt.", "Deposit Amt."], "bank")
    assert good.usable and good.columns["date"] == "Value Date" and {"debit", "credit"} <= set(good.columns)
    assert mapping.detect(["Date", "Net Amount", "Fee Amount", "Amount", "AMOUNT"], "ledger").ambiguous
    assert mapping.detect(["colour"], "payment").missing == ["amount", "date"]


def test_files_become_entries(spark, tmp_path):
    (tmp_path / "bank.csv").write_text("Txn Date,Narration,Withdrawal Amt.,Deposit Amt.\n02/01/2026,NEFT UTR123456789 x,,\"1,234.50\"\n03/01/2026,charges,118.00,\nlater,bad,1,\n")
    (tmp_path / "payments.json").write_text('{"items": [{"id": "p1", "amount": "500", "created_at": "2026-01-01"}]}')
    made, assessed = ingest.read_folder(spark, str(tmp_path))
    assert {(r.id, r.amount, r.reference) for r in made.collect()} == {("bank_0", 123450, "UTR123456789"), ("bank_1", -11800, None), ("p1", 500, "p1")}
    assert assessed.where("not accepted").count() == 1


def test_worklist_carries_on(spark, tmp_path):
    work = Worklist(spark, str(tmp_path / "w"))
    batch = entries(spark, [("rf_9", "refund", 700, D, "rf_9", None, "nobody"), ("bnk_7", "bank", 999999, D, None, "unknown")])
    result = reconcile(batch)
    work.record(result.exceptions, result.groups, batch, "r1")
    fingerprint = work.items().where("entry_id = 'rf_9'").first().fingerprint
    work.move(fingerprint, "resolved")
    with pytest.raises(ValueError):
        work.move(fingerprint, "investigating")
    work.record(result.exceptions, result.groups, batch, "r2")
    seen = {r.entry_id: (r.status, r.times_seen) for r in work.items().collect()}
    assert seen == {"rf_9": ("open", 2), "bnk_7": ("open", 2)}
    assert {r.event for r in work.history().collect()} == {"created", "status", "reopened"}


def test_subsets_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        pool = [(i, rng.randint(1, 40) * 5, rng.sample([1, 2, 3], rng.randint(1, 2))) for i in range(rng.randint(2, 12))]
        target = rng.randint(20, 300)
        sets = [c for k in range(2, 6) for c in itertools.combinations(pool, k) if set.intersection(*(set(u[2]) for u in c))]
        of = lambda off: {frozenset(u[0] for u in c) for c in sets if abs(sum(u[1] for u in c) - target) <= off}
        got = subset_options(pool, target, 5, 2, 60, 10**9, 10**9)
        assert set(map(frozenset, got)) == (of(0) or of(2)) and len(got) == len(of(0) or of(2))
    assert len(subset_options([(i, 100, [1]) for i in range(60)], 300, 6)) == 8


def plain_subsets(pool, target, most, slack, limit, stop, budget):
    """Every subset in turn, until as many as the budget have been looked at."""
    usable = [u for u in pool if 0 < u[1] <= target + slack]
    if len(usable) > limit:
        return []
    by_day, exact, near, seen = {}, [], [], set()
    for unit in usable:
        for day in sorted(unit[2]):
            by_day.setdefault(day, []).append(unit)
    for units in by_day.values():
        units = sorted(units, key=lambda u: u[1])
        for size in range(2, min(most, len(units)) + 1):
            for subset in itertools.combinations(units, size):
                budget -= 1
                if budget <= 0:
                    return exact or near
                off, names = abs(sum(u[1] for u in subset) - target), tuple(u[0] for u in subset)
                if off > slack or frozenset(names) in seen:
                    continue
                seen.add(frozenset(names))
                (near if off else exact).append(names)
                if len(exact) >= stop:
                    return exact
    return exact or near


def test_subsets_up_to_the_budget_against_plain_enumeration():
    rng = random.Random(6)
    for i in range(120):
        n = 60 if i % 3 == 0 else rng.randint(2, 60)
        pool = [(u, rng.randint(1, rng.choice([30, 1000, 10**8])), rng.sample([1, 2, 3], rng.randint(1, 3))) for u in range(n)]
        few = sorted(a for _, a, _ in pool)[: rng.randint(2, 6)] if i % 2 else [u[1] for u in rng.sample(pool, rng.randint(2, min(6, n)))]
        rule = (sum(few) + rng.choice([0, 0, 1, 2, 5]), rng.choice([4, 6]), 2, 60, 8, 400_000 if i % 4 == 0 else rng.choice([10, 100, 5000, 50_000]))
        assert subset_options(pool, *rule) == plain_subsets(pool, *rule)
    # a day of 60 units, whose four smallest add up to the target: more subsets of four than the budget, this one the first of them
    day = [(u, 1000 + 7 * u * u, [1]) for u in range(60)]
    assert (0, 1, 2, 3) in subset_options(day, sum(a for _, a, _ in day[:4]), 6)


def test_propagation_against_passes_in_order():
    rng = random.Random(5)
    for _ in range(1000):
        options = {a: list({tuple(sorted(rng.sample(range(12), 2))): 0 for _ in range(rng.randint(1, 3))}) for a in range(6)}
        chosen, taken, again = {}, set(), True
        while again:
            again = False
            for a in sorted(options.keys() - chosen.keys()):
                open_ = [o for o in options[a] if taken.isdisjoint(o)]
                if len(open_) == 1:
                    chosen[a], again = open_[0], True
                    taken.update(open_[0])
        assert propagate(options)[0] == chosen


def test_many_alike_are_refused_without_pairs(spark):
    n = 20_000
    sales = spark.range(n).selectExpr("concat('p', id) id", "'payment' source", "50000L amount", "date'2026-01-01' value_date", "concat('O', id) reference", "id ord")
    paid = spark.range(n).selectExpr("concat('s', id) id", "'settlement' source", "50000L amount", "date'2026-01-03' value_date", "concat('U', id) reference", f"id + {n} ord")
    batch = as_entries(sales.unionByName(paid).withColumns({"currency": F.lit("INR"), "fee": F.lit(0), "tax": F.lit(0)}))
    links, ambiguous = link_settlements(batch.withColumn("comp", F.col("ord")).withColumn("ref", F.col("reference")))
    assert links.count() == 0
    assert ambiguous.select("unit").distinct().count() == n and ambiguous.select("anchor").distinct().count() == n


def test_many_that_fit_a_day_are_counted_before_they_meet(spark):
    """20,000 amounts of one day and as many payouts, each above all of them: nothing may be gathered."""
    n = 20_000
    sales = spark.range(n).selectExpr("concat('p', id) id", "'payment' source", "70000L + 3 * id amount", "date'2026-01-01' value_date", "concat('O', id) reference", "id ord")
    paid = spark.range(n).selectExpr("concat('s', id) id", "'settlement' source", "140001L + 3 * id amount", "date'2026-01-03' value_date", "concat('U', id) reference", f"id + {n} ord")
    batch = as_entries(sales.unionByName(paid).withColumns({"currency": F.lit("INR"), "fee": F.lit(0), "tax": F.lit(0)})).withColumn("comp", F.col("ord")).withColumn("ref", F.col("reference"))
    began = time.time()
    links, ambiguous = link_settlements(batch)
    assert links.count() == ambiguous.count() == 0 and time.time() - began < 60


def test_few_subsets_are_made_without_arrays(monkeypatch):
    from tieout.operators import solver

    rng = random.Random(9)
    rules = []
    for _ in range(300):
        pool = [(i, rng.randint(1, 30), sorted({rng.randrange(2), rng.randrange(2)})) for i in range(rng.randint(1, 7))]
        rules.append((pool, sum(a for _, a, _ in pool[: rng.randint(1, 4)]) + rng.choice([0, 0, 1, 3]), rng.choice([2, 4]), 2, 60, rng.choice([1, 8]), rng.choice([2, 5, 20, 400_000])))
    monkeypatch.setattr(solver, "FEW", 0)
    by_arrays = [subset_options(*r) for r in rules]
    assert by_arrays == [plain_subsets(*r) for r in rules]
    monkeypatch.undo()
    monkeypatch.setattr(solver, "_summing", None)
    assert [subset_options(*r) for r in rules] == by_arrays and any(by_arrays)


def plain_pools(anchors, sales, lag, limit):
    out = {}
    for a, when, target in anchors:
        pool = sorted((min(d for d in days if abs((d - when).days + lag) <= 1), u, v) for u, v, days in sales if 0 < v <= target + 2 and any(abs((d - when).days + lag) <= 1 for d in days))
        if 2 <= len(pool) <= limit:
            out[a] = [(u, v) for _, u, v in pool]
    return out


def test_pools_against_each_pair(spark):
    rng = random.Random(2)
    day = lambda: D + dt.timedelta(rng.randint(0, 9))
    sales = [(u, rng.randint(-2, 60), sorted({day() for _ in range(rng.randint(1, 3))})) for u in range(300)]
    anchors = [(a, day(), rng.randint(1, 50)) for a in range(200)]
    free = spark.createDataFrame([(u, u, "INR", v, d, d) for u, v, d in sales], "unit long, uord long, currency string, v long, pay_dates array<date>, dates array<date>")
    rest = spark.createDataFrame([(a, "INR", w, t) for a, w, t in anchors], "anchor long, currency string, value_date date, target long").withColumn("start", F.date_sub("value_date", 3))
    settings = Settings(pool=12)
    pools = settlement._pools(rest, settlement._seen(free, "pay_dates", 2, lambda _: F.col("v")), settings)
    assert {r.anchor: [(u.unit, u.amount) for u in r.pool] for r in pools.collect()} == plain_pools(anchors, sales, 2, 12)


def test_candidate_pairs_against_each_pair(spark, many_parts):
    rng = random.Random(7)
    rows = [(f"e{i}", rng.choice(["bank", "ledger"]), rng.choice([-1, 1]) * rng.choice([rng.randint(1, 3000), rng.randint(10**5, 3 * 10**5), 777]), D, f"r{i}") for i in range(400)]
    batch = entries(spark, rows)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][2], i))
    want = set()
    for at, i in enumerate(order):
        reach = max(2000, abs(rows[i][2]) * 3 // 100)
        window = [j for j in order[at + 1 :] if rows[j][2] <= rows[i][2] + reach]
        if len(window) <= 40:
            want |= {(rows[i][0], rows[j][0]) for j in window if rows[i][1] != rows[j][1]}
    got = resolver.candidate_pairs(batch).select("a_id", "b_id").collect()
    assert set(map(tuple, got)) == want and len(got) == len(want) > 100


def test_pairs_are_shuffled_by_entry_and_words_taken_once_an_entry(spark):
    rows = [(f"e{i}", "bank" if i % 2 else "ledger", 10**6 + i, D, f"r{i}") for i in range(40)]
    pairs = resolver.candidate_pairs(entries(spark, rows))
    said = resolver.score(pairs)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in said
    at = [line for line in said.splitlines() if "Generate explode" in line]
    assert len(at) == 1 and "sequence(FLOOR" in at[0]  # one row a block of ranks rather than one a pair
    assert pairs.count() == 400


def plain_greedy(pairs):
    used, out = set(), set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used and b not in used:
            used |= {a, b}
            out.add((a, b, s))
    return out


def test_greedy_pairs_against_one_pass(spark):
    rng = random.Random(12)
    pairs = [(f"a{i}", f"b{j}", rng.choice([0.75, 0.8, 0.85, 0.9, 0.95])) for i in range(300) for j in rng.sample(range(300), 4)]
    pairs += [(f"c{i}", f"c{i + 1:05}" if i % 2 else f"c{i + 1}", 0.99 - i / 10**5) for i in range(500)]
    frame = spark.createDataFrame(pairs, "a_id string, b_id string, score double")
    got = resolver.greedy_pairs(frame).collect()
    assert set(map(tuple, got)) == plain_greedy(pairs) and len(got) == len(plain_greedy(pairs))


def test_a_chain_of_falling_scores_takes_one_round(spark):
    n = 4000
    pairs = spark.range(n).selectExpr("concat('e', id) a_id", "concat('e', id + 1) b_id", "0.99 - id / 100000 score").withColumn("score", F.col("score").cast("double"))
    won = resolver._settled(pairs)  # a single round settles the whole chain: every second pair
    assert won.count() == n // 2 and won.where("cast(substr(a_id, 2) as int) % 2 = 1").count() == 0


def test_rate_card_override(spark, tmp_path):
    (tmp_path / "card.json").write_text(json.dumps({"rules": {"Card": {"fixed_minor": 300}, "upi": {"percent_bps": "x"}, "voucher": {"percent_bps": 50}}}))
    card = {r.method: tuple(r)[1:4] for r in fees.rate_card(spark, str(tmp_path / "card.json")).collect()}
    assert card["card"] == (200, 300, 1800) and card["upi"] == (0, 0, 1800) and card["voucher"] == (50, 0, 1800)
    (tmp_path / "bad.json").write_text("no json")
    assert fees.rate_card(spark, str(tmp_path / "bad.json")).collect() == fees.rate_card(spark).collect()


@pytest.fixture()
def many_parts(spark):
    """Small tables in as many parts as they are dealt into."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_a_hot_reference_by_ranges_equals_the_window(spark, many_parts):
    rng = random.Random(11)
    refs = ["hot"] * 60 + ["Warm "] * 20 + [f"r{i}" for i in range(40)] + [None, ""]
    rows = [(f"e{i}", "bank", rng.choice([rng.randint(0, 4000), 777, -50]), D, rng.choice(refs)) for i in range(1500)]
    batch = entries(spark, rows).withColumn("currency", F.when(F.col("ord") % 7 == 0, "USD").otherwise("INR"))
    of = lambda rows: sorted(map(tuple, rows.select("id", "ord", "ref", "comp", "prev_id").collect()))
    plain = of(reference.exact_reference(batch))
    assert reference.hot_references(batch) is None
    hot = reference.hot_references(batch, 100)
    assert {tuple(r) for r in hot.collect()} >= {("hot", "INR"), ("warm", "INR")} and hot.count() < 20
    assert of(reference.exact_reference(batch, hot=hot)) == plain
    parts = reference._clusters_by_range(batch.withColumn("ref", F.lit("hot")), 100).groupBy("_part").count().collect()
    assert len(parts) > 1 and max(r["count"] for r in parts) < 1500 * 0.6
