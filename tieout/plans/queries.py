"""Queries by name over derived batches, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import json
import uuid
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieout.conf import Settings
from tieout.functions import fees
from tieout.functions import scalars as fn
from tieout.functions import sql
from tieout.operators import exceptions as exc
from tieout.operators import graph, reference, reports, resolver, settlement, units, worklist
from tieout.operators import groups as grp
from tieout.plans.engine import Result, cluster
from tieout.schema import as_entries
from tieout.sources import gateway, ingest, quality
from tieout.sources.derived import BATCH_SQL, base_of, batch
from tieout.tables import cut, shared_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SPAN = 10**13


def query(sql: str | None = None, derived: bool = True):
    """Register a query; ``sql`` may use the derived batch's tables ``base`` and ``entries``."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = (f"WITH {BATCH_SQL.strip()}{sql}" if derived else sql).strip()
        return f

    return register


def _orders(spark, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/orders.parquet")


def _base(spark, sf: str) -> DataFrame:
    return base_of(_orders(spark, sf))



def _k():
    return F.col("k")


def _text():
    return F.col("k").cast("string")


# ---- scans and scalar functions -------------------------------------------------------------------


@query(" SELECT id, source, amount, value_date, currency, reference, related, fee, tax FROM entries")
def scan_union_entries(spark, sf):
    return batch(spark, sf).select("id", "source", "amount", "value_date", "currency", "reference", "related", "fee", "tax")


@query(" SELECT source, currency, count(*) n, CAST(sum(amount) AS BIGINT) amount, min(value_date) first_date, max(value_date) last_date FROM entries GROUP BY ALL")
def entries_by_source(spark, sf):
    return batch(spark, sf).groupBy("source", "currency").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"), F.min("value_date").alias("first_date"), F.max("value_date").alias("last_date"))


@query(
    """, t AS (SELECT k, CASE k % 6 WHEN 0 THEN printf('%.2f', g / 100.0) WHEN 1 THEN CAST(g AS VARCHAR) WHEN 2 THEN '(' || printf('%.2f', g / 100.0) || ')'
      WHEN 3 THEN ' ₹1,' || printf('%.2f', g / 100.0) WHEN 4 THEN '-' ELSE 'n/a' END s FROM base),
    u AS (SELECT *, trim(regexp_replace(s, '[,₹]', '', 'g')) p FROM t), v AS (SELECT *, regexp_replace(p, '[()]', '', 'g') b FROM u)
    SELECT k, s, CASE WHEN p LIKE '(%)' THEN -1 ELSE 1 END * CAST(coalesce(CASE WHEN b LIKE '%.%' THEN round(TRY_CAST(b AS DOUBLE) * 100) ELSE TRY_CAST(b AS BIGINT) END, 0) AS BIGINT) minor FROM v"""
)
def parse_amount(spark, sf):
    fixed = F.format_string("%.2f", F.col("g") / 100)
    s = F.when(_k() % 6 == 0, fixed).when(_k() % 6 == 1, F.col("g").cast("string")).when(_k() % 6 == 2, F.concat(F.lit("("), fixed, F.lit(")"))).when(_k() % 6 == 3, F.concat(F.lit(" ₹1,"), fixed)).when(_k() % 6 == 4, "-").otherwise("n/a")
    return _base(spark, sf).select("k", s.alias("s")).withColumn("minor", fn.parse_minor(F.col("s")))


@query(
    """, t AS (SELECT k, CASE k % 6 WHEN 0 THEN strftime(d, '%Y-%m-%d') WHEN 1 THEN strftime(d, '%d-%m-%Y') WHEN 2 THEN strftime(d, '%d/%m/%Y') WHEN 3 THEN strftime(d, '%d %b %Y')
      WHEN 4 THEN strftime(d, '%Y-%m-%d') || 'T10:00:00' ELSE 'soon' END s FROM base)
    SELECT k, s, CAST(coalesce(try_strptime(s, '%Y-%m-%d'), try_strptime(s, '%d-%m-%Y'), try_strptime(s, '%d/%m/%Y'), try_strptime(s, '%d %b %Y'), try_strptime(s[1:10], '%Y-%m-%d'), TIMESTAMP '1970-01-01') AS DATE) AS "day" FROM t"""
)
def parse_date(spark, sf):
    f = lambda p: F.date_format("d", p)
    s = F.when(_k() % 6 == 0, f("yyyy-MM-dd")).when(_k() % 6 == 1, f("dd-MM-yyyy")).when(_k() % 6 == 2, f("dd/MM/yyyy")).when(_k() % 6 == 3, f("dd MMM yyyy")).when(_k() % 6 == 4, F.concat(f("yyyy-MM-dd"), F.lit("T10:00:00"))).otherwise("soon")
    return _base(spark, sf).select("k", s.alias("s")).withColumn("day", fn.parse_date(F.col("s")))


@query(
    """, t AS (SELECT k, CASE k % 4 WHEN 0 THEN 'NEFT utr' || (100000000 + k) || ' cr' WHEN 1 THEN 'paid for ORD' || (1000000 + k) WHEN 2 THEN 'ORD' || (1000000 + k) || '/UTR' || (100000000 + k) ELSE 'UTR' || (k % 1000) END s FROM base)
    SELECT k, upper(coalesce(nullif(regexp_extract(s, '(?i)\\b(UTR\\d{8,})\\b', 1), ''), nullif(regexp_extract(s, '(?i)\\b(ORD\\d{5,})\\b', 1), ''))) ref FROM t"""
)
def mine_reference(spark, sf):
    utr, order = F.concat(F.lit("UTR"), (_k() + 100000000).cast("string")), F.concat(F.lit("ORD"), (_k() + 1000000).cast("string"))
    s = F.when(_k() % 4 == 0, F.concat(F.lit("NEFT "), F.lower(utr), F.lit(" cr"))).when(_k() % 4 == 1, F.concat(F.lit("paid for "), order)).when(_k() % 4 == 2, F.concat(order, F.lit("/"), utr)).otherwise(F.concat(F.lit("UTR"), (_k() % 1000).cast("string")))
    return _base(spark, sf).select("k", fn.mine_reference(s).alias("ref"))


_METHODS = "CASE k % 5 WHEN 0 THEN 'upi' WHEN 1 THEN ' Card' WHEN 2 THEN 'netbanking' WHEN 3 THEN 'cheque' END"
_PRICED = f""", m AS (SELECT k, g, rf, cur, lower(trim({_METHODS})) method, CASE WHEN st <> 'O' THEN fee END reported_fee, CASE WHEN st <> 'O' THEN tax END reported_tax FROM base),
    p AS (SELECT *, (2 * g * CASE method WHEN 'upi' THEN 0 WHEN 'netbanking' THEN 180 ELSE 200 END + 10000) // 20000 rule_fee FROM m),
    q AS (SELECT *, (2 * rule_fee * 1800 + 10000) // 20000 rule_tax, (2 * g * 10 + 10000) // 20000 rule_tds FROM p)"""


def _priced(spark, sf):
    method = F.when(_k() % 5 == 0, "upi").when(_k() % 5 == 1, " Card").when(_k() % 5 == 2, "netbanking").when(_k() % 5 == 3, "cheque")
    said = F.col("st") != "O"
    sales = _base(spark, sf).select(
        "k", F.col("g").alias("gross"), method.alias("method"), F.col("cur").alias("currency"), F.when(said, F.col("fee")).alias("reported_fee"), F.when(said, F.col("tax")).alias("reported_tax"),
        F.lit(None).cast("long").alias("reported_tds"), F.col("rf").alias("refunds"), F.lit(0).cast("long").alias("chargebacks"),
    )
    return fees.priced(sales, fees.rate_card(spark), tds_bps=10)


@query(f"{_PRICED} SELECT k, rule_fee, rule_tax, rule_tds FROM q")
def rate_card_fees(spark, sf):
    return _priced(spark, sf).select("k", "rule_fee", "rule_tax", "rule_tds")


@query(
    f"""{_PRICED}, r AS (SELECT *, coalesce(reported_fee, rule_fee) fee, coalesce(reported_tax, rule_tax) tax FROM q)
    SELECT k, fee, tax, rule_tds tds, g - fee - tax - rule_tds - rf net, CASE WHEN reported_fee IS NULL THEN 'estimated' ELSE 'actual' END provenance FROM r"""
)
def fee_breakdown(spark, sf):
    return fees.breakdown(_priced(spark, sf)).select("k", "fee", "tax", "tds", "net", "provenance")


@query(
    f"{_PRICED} SELECT CASE WHEN reported_fee IS NULL THEN 'estimated' ELSE 'actual' END provenance, count(*) n, CAST(sum(coalesce(reported_fee, rule_fee)) AS BIGINT) fee FROM q GROUP BY 1"
)
def fee_provenance(spark, sf):
    return fees.breakdown(_priced(spark, sf)).groupBy("provenance").agg(F.count("*").alias("n"), F.sum("fee").alias("fee"))


@query(
    """, v AS (SELECT k, cur, CASE WHEN k % 9 = 0 THEN -g ELSE g END m FROM base), w AS (SELECT *, CAST(abs(m) // 100 AS VARCHAR) w, lpad(CAST(abs(m) % 100 AS VARCHAR), 2, '0') c FROM v)
    SELECT k, CASE WHEN m < 0 THEN '-' ELSE '' END || CASE WHEN cur = 'INR' THEN '₹' || CASE WHEN length(w) <= 3 THEN w ELSE ltrim(reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(\\d\\d)', '\\1,', 'g')), ',') || ',' || right(w, 3) END
      ELSE '$' || ltrim(reverse(regexp_replace(reverse(w), '(\\d\\d\\d)', '\\1,', 'g')), ',') END || '.' || c money FROM w"""
)
def money_format(spark, sf):
    minor = F.when(_k() % 9 == 0, -F.col("g")).otherwise(F.col("g"))
    return _base(spark, sf).select("k", fn.format_money(minor, F.col("cur")).alias("money"))


@query(
    " SELECT k, CASE WHEN a.cur = b.cur THEN a.g + b.g END total, CASE WHEN a.cur = b.cur THEN 'estimated' END provenance FROM base a JOIN (SELECT k - 1 k, g, cur FROM base) b USING (k)"
)
def amount_sum(spark, sf):
    b = _base(spark, sf).select("k", "g", "cur")
    amount = lambda p: F.struct(F.col("g").alias("minor"), F.col("cur").alias("currency"), F.lit(p).alias("provenance")).alias(p)
    both = b.select("k", amount("actual")).join(b.select((_k() - 1).alias("k"), amount("estimated")), "k")
    return both.select("k", fn.add_amounts(F.col("actual"), F.col("estimated")).alias("s")).select("k", F.col("s.minor").alias("total"), "s.provenance")


@query(
    """SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{3,}'))) AS BIGINT) n_tokens FROM documents""",
    derived=False,
)
def distinct_tokens(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.size(fn.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query(
    """, i AS (SELECT 'pay_' || k id, g amount, cur, CASE k % 4 WHEN 0 THEN 'missing_in_bank' WHEN 1 THEN 'duplicate' WHEN 2 THEN 'orphan_chargeback' ELSE 'unknown' END category FROM base)
    SELECT id || '|' || category || '|' || amount || '|' || cur fingerprint, CASE WHEN category IN ('missing_in_bank', 'orphan_chargeback') THEN CASE WHEN amount >= 100000 THEN 'critical' ELSE 'high' END
      WHEN amount >= 500000 THEN 'high' WHEN category = 'duplicate' THEN 'low' ELSE 'medium' END priority FROM i"""
)
def priority_fingerprint(spark, sf):
    category = F.when(_k() % 4 == 0, "missing_in_bank").when(_k() % 4 == 1, "duplicate").when(_k() % 4 == 2, "orphan_chargeback").otherwise("unknown")
    i = _base(spark, sf).select(F.concat(F.lit("pay_"), _text()).alias("id"), F.col("g").alias("amount"), "cur", category.alias("category"))
    return i.select(fn.exception_key(F.col("id"), F.col("category"), F.col("amount"), F.col("cur")).alias("fingerprint"), fn.priority(F.col("category"), F.col("amount")).alias("priority"))


# ---- checks and identifiers -----------------------------------------------------------------------

_ROWS = """, q AS (SELECT k, CASE WHEN k % 50 = 0 THEN NULL WHEN k % 41 = 0 THEN 'p' || (k - k % 82) ELSE 'p' || k END id, CASE WHEN k % 31 = 0 THEN '' WHEN k % 29 = 0 THEN 'abc' WHEN k % 37 = 0 THEN '-12.50' ELSE CAST(g AS VARCHAR) END amount,
    CASE WHEN k % 43 = 0 THEN '' WHEN k % 47 = 0 THEN 'later' ELSE strftime(d, '%Y-%m-%d') END date, CASE WHEN k % 23 = 0 THEN 'XYZ' ELSE cur END currency FROM base),
    n AS (SELECT *, row_number() OVER (PARTITION BY coalesce(id, 'row ' || k) ORDER BY k) nth FROM q),
    x AS (SELECT k, id, CAST(amount = '' AS INT) + CAST(amount = 'abc' AS INT) + CAST(date IN ('', 'later') AS INT) + CAST(nth > 1 AS INT) errors, CAST(amount = '-12.50' AS INT) + CAST(currency = 'XYZ' AS INT) warnings FROM n)"""


def _assessed(spark, sf):
    k = lambda n: _k() % n == 0
    rows = _base(spark, sf).select(
        _k().alias("_row"), F.when(k(50), None).when(k(41), F.concat(F.lit("p"), (_k() - _k() % 82).cast("string"))).otherwise(F.concat(F.lit("p"), _text())).alias("id"),
        F.when(k(31), "").when(k(29), "abc").when(k(37), "-12.50").otherwise(F.col("g").cast("string")).alias("amount"), F.lit(None).cast("double").alias("amount_major"),
        F.when(k(43), "").when(k(47), "later").otherwise(F.date_format("d", "yyyy-MM-dd")).alias("date"), F.when(k(23), "XYZ").otherwise(F.col("cur")).alias("currency"),
        *[F.lit(None).cast("string").alias(c) for c in ("reference", "narration", "payment_id")], F.col("st").alias("source"),
    )
    return quality.assess(rows, "payment")


@query(f"{_ROWS} SELECT k, errors, warnings, errors = 0 accepted FROM x")
def quality_issues(spark, sf):
    n = lambda s: F.size(F.filter("issues", lambda i: i.severity == s)).alias(f"{s}s")
    return _assessed(spark, sf).select(F.col("_row").alias("k"), n("error"), n("warning"), "accepted")


@query(f"{_ROWS} SELECT count(*) rows, count(*) FILTER (errors = 0) accepted, count(*) FILTER (errors > 0) quarantined, CAST(0 AS BIGINT) empty FROM x")
def quality_summary(spark, sf):
    return quality.summary(_assessed(spark, sf)).select("rows", "accepted", "quarantined", "empty")


@query(f"{_ROWS} SELECT b.st source, count(*) rows, count(*) FILTER (errors = 0) accepted FROM x JOIN base b USING (k) GROUP BY ROLLUP (b.st)")
def quality_rollup(spark, sf):
    return quality.rollup(_assessed(spark, sf)).select("source", "rows", "accepted")


@query(
    """, r AS (SELECT 'id' || (k // 3) id, k ord FROM base), n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) nth FROM r)
    SELECT ord, CASE WHEN nth > 1 THEN id || '#' || nth ELSE id END id FROM n"""
)
def disambiguate_ids(spark, sf):
    rows = _base(spark, sf).select(_k().alias("ord"), F.concat(F.lit("id"), F.call_function("div", _k(), F.lit(3)).cast("string")).alias("id"))
    return ingest.disambiguate(rows).select("ord", "id")


@query(
    """ SELECT 'card' AS method, 'pay_' || (row_number() OVER (ORDER BY k) - 1) id, g amount, d value_date, cur currency, 'ORD' || k reference FROM base WHERE k % 7 <> 0"""
)
def ingest_payments(spark, sf):
    """Headings, text amounts and dates of a payment export, through mapping, checks and normalising."""
    b = _base(spark, sf).orderBy("k")
    raw = b.select(
        F.date_format("d", "dd/MM/yyyy").alias("Created At"), F.concat(F.lit("ORD"), _text()).alias("Order Id"), F.lit("card").alias("Method"), F.col("cur").alias("Currency"),
        F.when(_k() % 7 == 0, "").otherwise(F.format_string("%.2f", F.col("g") / 100)).alias("Amount"),
    )
    entries, _ = ingest.entries_of({"payment": raw})
    return entries.select("id", "amount", "value_date", "currency", "reference", "method")


# ---- rules by reference ---------------------------------------------------------------------------

_ISLANDS = """, h AS (SELECT *, lower(trim(reference)) ref FROM entries WHERE reference IS NOT NULL),
    l AS (SELECT *, lag(id) OVER w prev_id, coalesce(amount - lag(amount) OVER w > 100, true) fresh FROM h WINDOW w AS (PARTITION BY ref, currency ORDER BY amount, ord)),
    c AS (SELECT *, sum(CAST(fresh AS INT)) OVER (PARTITION BY ref, currency ORDER BY amount, ord) island FROM l)"""


@query(f"{_ISLANDS} SELECT prev_id a, id b, ref, currency FROM l WHERE NOT fresh")
def exact_reference_edges(spark, sf):
    return reference.reference_edges(reference.exact_reference(batch(spark, sf)))


@query(f"{_ISLANDS} SELECT min(ord) comp, count(*) members, CAST(sum(amount) AS BIGINT) amount FROM c GROUP BY ref, currency, island")
def exact_reference_clusters(spark, sf):
    c = reference.exact_reference(batch(spark, sf)).where("ref is not null")
    return c.groupBy("comp").agg(F.count("*").alias("members"), F.sum("amount").alias("amount"))


def _twice_refunded(spark, sf):
    """The batch with a second, three times as large refund of every other refunded payment."""
    e = batch(spark, sf)
    again = e.where(f"source = 'refund' and ord % {SPAN} % 38 = 0").withColumns({"id": F.concat(F.lit("again_"), "id"), "reference": F.concat(F.lit("again_"), "reference"), "amount": F.col("amount") * 3, "ord": F.col("ord") + SPAN})
    return e.unionByName(again)


_LINKS = f""", f AS (SELECT id, amount, currency, related, ord FROM entries WHERE source = 'refund' UNION ALL SELECT 'again_' || id, amount * 3, currency, related, ord + {SPAN} FROM entries WHERE source = 'refund' AND ord % {SPAN} % 38 = 0),
    j AS (SELECT f.id, p.id payment_id, p.amount payment_amount, f.amount, f.ord FROM f JOIN entries p ON p.source = 'payment' AND p.id = f.related)"""


@query(f"{_LINKS} SELECT id, payment_id, CAST(sum(amount) OVER (PARTITION BY payment_id ORDER BY ord) AS BIGINT) claimed, CAST(payment_amount - sum(amount) OVER (PARTITION BY payment_id ORDER BY ord) AS BIGINT) left_over FROM j")
def deduction_links(spark, sf):
    return reference.deduction_links(reference.exact_reference(_twice_refunded(spark, sf))).select("id", "payment_id", "claimed", "left_over")


@query(f"{_LINKS} SELECT payment_id, CAST(sum(amount) AS BIGINT) deducted, CAST(sum(amount) - max(payment_amount) AS BIGINT) excess FROM j GROUP BY 1 HAVING sum(amount) > max(payment_amount)")
def over_refund(spark, sf):
    return reference.over_refunds(reference.deduction_links(reference.exact_reference(_twice_refunded(spark, sf)))).select("payment_id", "deducted", "excess")


#: Components of the derived batch after the reference rules.
_KEYED = f""", numbered AS (SELECT *, ord % {SPAN} k FROM entries), keyed AS (SELECT *, CASE WHEN source IN ('payment', 'ledger') OR source = 'refund' AND k % 57 <> 0 THEN 'O' WHEN source = 'refund' THEN 'R'
    WHEN source = 'settlement' OR k % 13 <> 0 AND k % 17 <> 0 THEN 'S' ELSE 'B' END || k AS key FROM numbered)"""


@query(
    f"""{_KEYED} SELECT min(ord) comp, count(*) members, CAST(coalesce(sum(amount) FILTER (source = 'payment'), 0) AS BIGINT) pay, CAST(coalesce(sum(amount) FILTER (source = 'refund'), 0) AS BIGINT) deducted,
    CAST(coalesce(max(amount) FILTER (source = 'payment'), max(amount)) - coalesce(sum(amount) FILTER (source = 'refund'), 0) AS BIGINT) gross, string_agg(DISTINCT source, '+' ORDER BY source) sources FROM keyed GROUP BY key"""
)
def unit_aggregate(spark, sf):
    clustered, _ = cluster(batch(spark, sf))
    zero = lambda c, name: F.coalesce(c, F.lit(0)).cast("long").alias(name)
    return units.units(clustered).select("comp", "members", zero(F.col("pay"), "pay"), zero(F.col("all_deductions"), "deducted"), "gross", F.array_join("sources", "+").alias("sources"))


@query(" SELECT k, g gross_before, g - CASE WHEN k % 57 = 0 THEN 0 ELSE rf END gross_after FROM base")
def gross_as_of(spark, sf):
    clustered, _ = cluster(batch(spark, sf))
    u = units.units(clustered).where(units.has("payment")).withColumn("day", F.get("pay_dates", F.lit(0)))
    return u.select(F.col("comp").alias("k"), units.gross_as_of(F.col("day")).alias("gross_before"), units.gross_as_of(F.date_add("day", 1)).alias("gross_after"))


# ---- amounts in windows ---------------------------------------------------------------------------

_SALES = """, t AS (SELECT k, cur, net + fee + tax t, CAST(d + 2 AS DATE) sd FROM base WHERE st <> 'O'), u AS (SELECT k, cur, d, g - CASE WHEN k % 57 = 0 THEN 0 ELSE rf END gross FROM base),
    cand AS (SELECT t.k sk, u.k uk, u.gross = t.t exact FROM t, (VALUES (-1), (0), (1)) o(o), u WHERE u.cur = t.cur AND u.d = t.sd - 2 + o.o AND abs(u.gross - t.t) <= 2),
    pref AS (SELECT * FROM cand QUALIFY exact OR NOT bool_or(exact) OVER (PARTITION BY sk)),
    l1 AS (SELECT sk, uk FROM pref QUALIFY count(*) OVER (PARTITION BY sk) = 1 AND count(*) OVER (PARTITION BY uk) = 1)"""
_CREDITS = """, bc AS (SELECT k, cur, d, net - CASE WHEN k % 17 = 0 THEN 1180 ELSE 0 END amt FROM base WHERE st = 'F' AND (k % 13 = 0 OR k % 17 = 0)),
    sc AS (SELECT k, cur, d, net FROM base WHERE st = 'P' OR st = 'F' AND (k % 13 = 0 OR k % 17 = 0)),
    bcand AS (SELECT bc.k bk, sc.k sk FROM bc, (VALUES (-1), (0), (1)) o(o), sc WHERE sc.cur = bc.cur AND sc.d = bc.d + o.o AND sc.net = bc.amt AND bc.amt > 0 AND (bc.k % 13 = 0 OR bc.k = sc.k)),
    l2 AS (SELECT bk, sk FROM bcand QUALIFY count(*) OVER (PARTITION BY bk) = 1 AND count(*) OVER (PARTITION BY sk) = 1)"""
_PLACED = """, placed AS (SELECT e.*, CASE left(key, 1) WHEN 'S' THEN coalesce('O' || a.uk, key) WHEN 'B' THEN coalesce('O' || b.uk, 'S' || l2.sk, key) ELSE key END comp
    FROM keyed e LEFT JOIN l1 a ON e.key = 'S' || a.sk LEFT JOIN l2 ON e.key = 'B' || l2.bk LEFT JOIN l1 b ON b.sk = l2.sk),
    g0 AS (SELECT comp, count(*) members, string_agg(id, ',' ORDER BY id) entry_ids, max(value_date) last_date, any_value(currency) currency, bool_or(source = 'bank') bank, bool_or(source = 'settlement') setl,
      bool_or(source IN ('payment', 'ledger')) book, coalesce(sum(amount) FILTER (source = 'payment'), 0) pay, coalesce(sum(amount) FILTER (source = 'ledger'), 0) led, coalesce(sum(amount + fee + tax) FILTER (source = 'settlement'), 0) sg,
      coalesce(sum(amount) FILTER (source = 'bank' AND amount > 0), 0) credit, max(amount) largest, coalesce(sum(amount) FILTER (source = 'refund'), 0) ded FROM placed GROUP BY comp),
    g1 AS (SELECT *, CAST(coalesce(nullif(pay, 0), nullif(led, 0), nullif(sg, 0), nullif(credit, 0), largest) AS BIGINT) amount, (SELECT max(value_date) FROM entries) - last_date age FROM g0 WHERE members > 1),
    g AS (SELECT *, CASE WHEN book AND NOT bank AND coalesce(nullif(pay, 0), led) > 0 AND ded >= coalesce(nullif(pay, 0), led) THEN 'fully_refunded' WHEN bank AND book THEN 'complete' WHEN bank THEN 'unbooked_payout'
      WHEN setl AND book THEN CASE WHEN age <= 3 THEN 'awaiting_payout' ELSE 'payout_overdue' END WHEN book THEN CASE WHEN age <= 4 THEN 'awaiting_settlement' ELSE 'payout_overdue' END ELSE 'partial' END status FROM g1),
    res AS (SELECT p.* FROM placed p JOIN (SELECT comp FROM g0 WHERE members = 1) USING (comp))"""
_NEAR = "EXISTS (SELECT 1 FROM entries o, (VALUES (-1), (0), (1)) w(w) WHERE o.source = '{}' AND o.amount // 201 = r.amount // 201 + w.w AND abs(o.amount - r.amount) <= 100)"
_RAISED = f""", ex AS (SELECT id, source, amount, currency, CASE WHEN source = 'refund' THEN 'orphan_refund' WHEN source = 'bank' AND amount < 0 THEN 'fee_mismatch'
    WHEN source = 'bank' AND amount > 0 AND EXISTS (SELECT 1 FROM entries s WHERE s.source = 'settlement' AND s.reference = r.reference) THEN 'fee_mismatch'
    WHEN source = 'bank' AND amount > 0 AND NOT {_NEAR.format("ledger")} THEN 'missing_in_ledger' WHEN source = 'bank' THEN 'unknown'
    WHEN source = 'ledger' AND NOT {_NEAR.format("bank")} THEN 'missing_in_bank' WHEN source = 'ledger' THEN 'amount_mismatch' WHEN source = 'payment' THEN 'missing_in_bank' WHEN source = 'settlement' THEN 'payout_in_transit' END category FROM res r)"""


def _linked(spark, sf, subsets=False):
    """(entries, entries with comp after all one-to-one rules, payout links, credit links)."""
    settings = Settings.of(spark)
    entries = batch(spark, sf)
    clustered, _ = cluster(entries, settings)
    clustered = cut(clustered.drop("prev_id"), "clustered")
    s_links, _ = settlement.link_settlements(clustered, settings, subsets)
    s_links = cut(s_links, "payouts")
    with_s = cut(settlement.relabel(clustered, s_links), "paid")
    b_links = cut(settlement.link_banks(with_s, settings, subsets), "credits")
    return entries, cut(settlement.relabel(with_s, b_links), "linked"), s_links, b_links


@query(f"{_SALES} SELECT sk k, uk unit, 'payment-to-settlement@v1' AS rule FROM l1")
def settlement_one_to_one(spark, sf):
    settings = Settings.of(spark)
    clustered, _ = cluster(batch(spark, sf), settings)
    links, _ = settlement.link_settlements(cut(clustered.drop("prev_id"), "clustered"), settings, subsets=False)
    return links.where("rule = 'payment-to-settlement@v1'").select((F.col("anchor") % SPAN).alias("k"), (F.col("unit") % SPAN).alias("unit"), "rule")


@query(f"{_CREDITS} SELECT bk k, sk settlement FROM l2")
def bank_one_to_one(spark, sf):
    entries, linked, _, b_links = _linked(spark, sf)
    # a unit is named by its first entry, a payment once its payout is linked
    setl = linked.where("source = 'settlement'").select("comp", F.col("ord").alias("settlement"))
    anchors = linked.where("source = 'bank'").select(F.col("ord").alias("anchor"), "comp")
    return b_links.join(anchors, "anchor").join(setl, "comp").select((F.col("anchor") % SPAN).alias("k"), (F.col("settlement") % SPAN).alias("settlement"))


@query(f"{_SALES.replace('CAST(d + 2 AS DATE) sd', 'CAST(d + CASE WHEN k % 29 = 0 THEN 22 ELSE 2 END AS DATE) sd')}, rest AS (SELECT * FROM t WHERE k NOT IN (SELECT sk FROM l1)), free AS (SELECT u.k, u.cur, u.d, b.g, b.rf FROM u JOIN base b USING (k) WHERE k NOT IN (SELECT uk FROM l1)),"
    """ late AS (SELECT r.k sk, f.k uk FROM rest r JOIN free f ON f.cur = r.cur AND f.d <= r.sd AND r.sd - f.d <= 60 AND r.t = f.g - CASE WHEN f.k % 57 <> 0 AND f.d + 1 <= r.sd THEN f.rf ELSE 0 END)
    SELECT sk k, uk unit FROM late QUALIFY count(*) OVER (PARTITION BY sk) = 1 AND count(*) OVER (PARTITION BY uk) = 1""")
def late_payout_asof(spark, sf):
    late = (F.col("source") == "settlement") & (F.col("ord") % SPAN % 29 == 0)
    entries = batch(spark, sf).withColumn("value_date", F.when(late, F.date_add("value_date", 20)).otherwise(F.col("value_date")))
    clustered, _ = cluster(entries)
    links, _ = settlement.link_settlements(cut(clustered.drop("prev_id"), "clustered"), subsets=False)
    return links.where("rule = 'late-payout@v1'").select((F.col("anchor") % SPAN).alias("k"), (F.col("unit") % SPAN).alias("unit"))


_SETS = f""", p AS (SELECT k, k // 3 b, g, cur FROM base), days AS (SELECT b, count(*) n, CAST(sum(g) AS BIGINT) total FROM p GROUP BY b),
    subsets AS (SELECT b, [k] ks, CAST(g AS BIGINT) s FROM p UNION ALL SELECT x.b, [x.k, y.k], x.g + y.g FROM p x JOIN p y ON x.b = y.b AND x.k < y.k UNION ALL SELECT x.b, [x.k, y.k, z.k], x.g + y.g + z.g FROM p x JOIN p y ON x.b = y.b AND x.k < y.k JOIN p z ON y.b = z.b AND y.k < z.k),
    hits AS (SELECT d.b, ks FROM days d JOIN subsets s ON s.b = d.b AND s.s = d.total AND len(ks) > 1 QUALIFY count(*) OVER (PARTITION BY d.b) = 1)"""


def _sets(spark, sf, size: int, settled: bool):
    """Sales of ``size`` orders a batch, five days apart, and one entry that pays a whole batch."""
    b = F.call_function("div", _k(), F.lit(size))
    # every batch has days of its own in its currency
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("b") % 100_000 * 5).cast("int"))
    rows = _base(spark, sf).select("k", b.alias("b"), "g").withColumn("value_date", day).withColumn("currency", F.concat(F.lit("C"), F.call_function("div", F.col("b"), F.lit(100_000)).cast("string")))
    leaf, top = ("settlement", "bank") if settled else ("payment", "settlement")
    parts = rows.select(F.concat(F.lit("part_"), _text()).alias("id"), F.lit(leaf).alias("source"), F.col("g").alias("amount"), "value_date", "currency", F.concat(F.lit("P"), _text()).alias("reference"), _k().alias("ord"))
    whole = rows.groupBy("b", "value_date", "currency").agg(F.sum("g").alias("amount"))
    whole = whole.select(F.concat(F.lit("whole_"), F.col("b").cast("string")).alias("id"), F.lit(top).alias("source"), "amount", F.date_add("value_date", 0 if settled else 2).alias("value_date"), "currency", (F.col("b") + SPAN).alias("ord"))
    return as_entries(parts.unionByName(whole, allowMissingColumns=True).withColumns({"fee": F.lit(0), "tax": F.lit(0)}))


@query(f"{_SETS} SELECT b, unnest(ks) unit FROM hits")
def split_batch(spark, sf):
    """One payout of several payments: subsets of a shared day that sum to it, where only one does."""
    clustered, _ = cluster(_sets(spark, sf, 3, False))
    links, _ = settlement.link_settlements(cut(clustered.drop("prev_id"), "clustered"))
    return links.where("rule = 'split-settlement@v1'").select((F.col("anchor") - SPAN).alias("b"), "unit")


@query(f"{_SETS.replace('k // 3', 'k // 2')} SELECT b, unnest(ks) unit FROM hits")
def merged_credit(spark, sf):
    """One bank credit of several payouts."""
    clustered, _ = cluster(_sets(spark, sf, 2, True))
    links = settlement.link_banks(cut(clustered.drop("prev_id"), "clustered"))
    return links.where("rule = 'merged-bank-credit@v1'").select((F.col("anchor") - SPAN).alias("b"), "unit")


@query(
    """WITH RECURSIVE e AS (SELECT c_custkey a, c_custkey + 7 b FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey + 7 <= (SELECT max(c_custkey) FROM customer)),
    both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), r(node, seen) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.node, b.b FROM r JOIN both_ways b ON b.a = r.seen)
    SELECT node, min(seen) root FROM r GROUP BY node""",
    derived=False,
)
def connected_components(spark, sf):
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").alias("a"))
    top = c.agg(F.max("a").alias("top"))  # one row
    edges = c.join(F.broadcast(top)).where("a % 5 <> 0 and a + 7 <= top").select("a", (F.col("a") + 7).alias("b"))
    return graph.connected_components(edges)


# ---- residual -------------------------------------------------------------------------------------

_RESIDUAL = """, x AS (SELECT 'b' || k id, 'bank' source, g amount, CAST(d + CAST(k % 5 AS INT) AS DATE) value_date, cur || (k // 500) AS currency, 'transfer cust ' || (k % 97) AS narration, k + 20000000000000 ord FROM base
      UNION ALL SELECT 'l' || k, 'ledger', g + (k % 3) * 50, d, cur || (k // 500), 'cust ' || (k % 97), k + 30000000000000 FROM base),
    z AS (SELECT a.id a_id, b.id b_id, a.source a_source, b.source b_source, a.amount a_amount, b.amount b_amount, a.narration an, b.narration bn, a.value_date ad, b.value_date bd, count(*) OVER (PARTITION BY a.id) n
      FROM x a JOIN x b ON a.currency = b.currency AND b.amount <= a.amount + greatest(2000, abs(a.amount) * 3 // 100) AND b.amount >= a.amount AND (b.amount > a.amount OR b.ord > a.ord))"""


def _residual(spark, sf):
    # currencies of 500 orders, so that amounts lie as far apart in a large table as in a small one
    b = _base(spark, sf).withColumn("cur", F.concat("cur", F.call_function("div", _k(), F.lit(500)).cast("string")))
    customer = F.concat(F.lit("cust "), (_k() % 97).cast("string"))
    bank = b.select(F.concat(F.lit("b"), _text()).alias("id"), F.lit("bank").alias("source"), F.col("g").alias("amount"), F.date_add("d", (_k() % 5).cast("int")).alias("value_date"), F.col("cur").alias("currency"), F.concat(F.lit("transfer "), customer).alias("narration"), (_k() + 2 * SPAN).alias("ord"))
    ledger = b.select(F.concat(F.lit("l"), _text()).alias("id"), F.lit("ledger").alias("source"), (F.col("g") + _k() % 3 * 50).alias("amount"), F.col("d").alias("value_date"), F.col("cur").alias("currency"), customer.alias("narration"), (_k() + 3 * SPAN).alias("ord"))
    return as_entries(bank.unionByName(ledger))


@query(f"{_RESIDUAL} SELECT a_id, b_id FROM z WHERE n <= 40 AND a_source <> b_source")
def candidate_pairs(spark, sf):
    return resolver.candidate_pairs(_residual(spark, sf)).select("a_id", "b_id")


@query(
    f"""{_RESIDUAL}, y AS (SELECT *, abs(a_amount - b_amount) gap, abs(ad - bd) n_days, list_distinct(regexp_extract_all(an, '[a-z0-9]{{3,}}')) ta, list_distinct(regexp_extract_all(bn, '[a-z0-9]{{3,}}')) tb FROM z WHERE a_source <> b_source)
    SELECT a_id, b_id, CAST(round(1000 * (0.55 * CASE WHEN gap <= 2 THEN 1.0 ELSE 0.6 END + 0.2 * CASE WHEN n_days <= 3 THEN 1.0 WHEN n_days <= 7 THEN 0.6 ELSE 0.2 END + 0.15 * len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))))) AS BIGINT) score FROM y"""
)
def pair_scores(spark, sf):
    """Scores of all pairs that amounts leave open, however many rows lie in an entry's window."""
    scored = resolver.score(resolver.candidate_pairs(_residual(spark, sf), crowd=None))
    return scored.select("a_id", "b_id", F.round(F.col("score") * 1000).cast("long").alias("score"))


@query()
def greedy_pairs(spark, sf):
    return resolver.greedy_pairs(resolver.score(resolver.candidate_pairs(_residual(spark, sf))))


@query(" SELECT id FROM entries r WHERE source = 'bank' AND " + _NEAR.format("ledger"))
def near_amount_semi(spark, sf):
    e = batch(spark, sf)
    return exc.near_amounts(e.where("source = 'bank'"), e.where("source = 'ledger'")).select("id")


@query(" SELECT id FROM entries r WHERE source = 'bank' AND NOT " + _NEAR.format("ledger"))
def near_amount_anti(spark, sf):
    e = batch(spark, sf)
    return exc.no_near_amounts(e.where("source = 'bank'"), e.where("source = 'ledger'")).select("id")


@query(" SELECT 'led_' || k id, 'dup_' || k kept_id, g amount FROM base WHERE k % 23 = 0 AND k % 11 <> 0 UNION ALL SELECT 'set_' || k, 'again_' || k, net FROM base WHERE k % 46 = 0 AND st <> 'O'")
def duplicates_in_group(spark, sf):
    """Repeated ledger rows, and payouts repeated on the same day (another day would be no repeat)."""
    e = batch(spark, sf)
    k = F.col("ord") % SPAN
    led = e.where("source = 'ledger'").where(k % 23 == 0).withColumns({"id": F.concat(F.lit("dup_"), k.cast("string")), "ord": F.col("ord") + 5 * SPAN})
    pay = e.where("source = 'settlement'").where(k % 23 == 0).withColumns({"id": F.concat(F.lit("again_"), k.cast("string")), "ord": F.col("ord") + 5 * SPAN, "value_date": F.when(k % 2 == 0, F.col("value_date")).otherwise(F.date_add("value_date", 1))})
    clustered, _ = cluster(e.unionByName(led).unionByName(pay))
    return exc.duplicates_in_groups(clustered).select("id", "kept_id", "amount")


@query(f"{_KEYED}{_SALES}{_CREDITS}{_PLACED}{_RAISED} SELECT id, source, amount, category FROM ex")
def classify_residual(spark, sf):
    entries, linked, _, _ = _linked(spark, sf)
    return exc.classify_residual(_singles(linked), entries).select("id", "source", "amount", "category")


def _singles(linked: DataFrame) -> DataFrame:
    return linked.join(linked.groupBy("comp").count().where("count = 1").select("comp"), "comp", "left_semi")


# ---- groups, money, accuracy ----------------------------------------------------------------------


@query(f"{_KEYED}{_SALES}{_CREDITS}{_PLACED} SELECT entry_ids, amount, status FROM g")
def group_status(spark, sf):
    entries, linked, _, _ = _linked(spark, sf)
    return grp.status(grp.groups(linked), entries).select(F.array_join("entry_ids", ",").alias("entry_ids"), F.col("amount").cast("long").alias("amount"), "status")


@query(f"{_KEYED}{_SALES}{_CREDITS}{_PLACED} SELECT status, currency, count(*) n, CAST(sum(amount) AS BIGINT) amount FROM g GROUP BY 1, 2")
def status_counts(spark, sf):
    entries, linked, _, _ = _linked(spark, sf)
    return grp.status(grp.groups(linked), entries).groupBy("status", "currency").agg(F.count("*").alias("n"), F.sum("amount").cast("long").alias("amount"))


def _money(by: str) -> str:
    of = lambda t, c, when: f"coalesce((SELECT sum(amount) FROM {t} z WHERE {when}{c}), 0)"
    c = " AND z.currency = c.currency" if by else ""
    parts = {
        "gross_processed": of("entries", c, "source = 'payment'"), "reconciled": of("g", c, "status = 'complete'"), "in_transit": of("g", c, "status IN ('awaiting_settlement', 'awaiting_payout')"),
        "recoverable": of("g", c, "status IN ('payout_overdue', 'partial')") + " + " + of("ex", c, "amount > 0 AND category IN ('missing_in_bank', 'fee_mismatch')"),
        "unrecorded": of("g", c, "status = 'unbooked_payout'") + " + " + of("ex", c, "category = 'missing_in_ledger'"), "ambiguous": of("g", c, "status = 'ambiguous_split'"), "in_exception": of("ex", c, "true"),
    }
    listed = ", ".join(f"CAST({v} AS BIGINT) {k}" for k, v in parts.items())
    return f"{_KEYED}{_SALES}{_CREDITS}{_PLACED}{_RAISED} SELECT {by and 'currency, '}{listed}" + (" FROM (SELECT DISTINCT currency FROM entries) c" if by else "")


def _summary(spark, sf, per_currency):
    entries, linked, _, _ = _linked(spark, sf)
    g = grp.status(grp.groups(linked), entries)
    return grp.money_summary(entries, g, exc.classify_residual(_singles(linked), entries), per_currency)


@query(_money(""))
def money_summary(spark, sf):
    return _summary(spark, sf, False)


@query(_money("currency"))
def money_by_currency(spark, sf):
    return _summary(spark, sf, True)


_TRUE = f"(SELECT id, ord % {SPAN} t FROM entries)"


@query(
    f"""{_ISLANDS}, p AS (SELECT id, min(ord) OVER (PARTITION BY ref, currency, island) grp FROM c), t AS {_TRUE},
    n AS (SELECT (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) n FROM p JOIN t USING (id) GROUP BY grp, t)) hit, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) n FROM p GROUP BY grp)) predicted, (SELECT sum(n * (n - 1) // 2) FROM (SELECT count(*) n FROM t GROUP BY t)) AS truth)
    SELECT CAST(hit AS BIGINT) hit, CAST(predicted AS BIGINT) predicted, CAST(truth AS BIGINT) "true" FROM n"""
)
def pair_precision_recall(spark, sf):
    e = batch(spark, sf)
    predicted = reference.exact_reference(e).where("ref is not null").select("id", F.col("comp").alias("grp"))
    return grp.pair_scores(predicted, e.select("id", (F.col("ord") % SPAN).alias("grp"))).select("hit", "predicted", "true")


@query(
    f"""{_ISLANDS}, p AS (SELECT id, amount, min(ord) OVER (PARTITION BY ref, currency, island) grp, CASE WHEN ord % {SPAN} % 10 <> 0 THEN ord % {SPAN} END t FROM c), v AS (SELECT grp, max(amount) amount, count(DISTINCT t) = 1 AND count(t) = count(*) ok FROM p GROUP BY grp)
    SELECT CAST(sum(amount) FILTER (ok) AS BIGINT) right_value, CAST(sum(amount) AS BIGINT) value, CAST(sum(amount) - sum(amount) FILTER (ok) AS BIGINT) false_match_cost FROM v"""
)
def value_precision(spark, sf):
    e = batch(spark, sf)
    grouped = reference.exact_reference(e).where("ref is not null").select("id", F.col("comp").alias("grp"), "amount")
    return grp.value_precision(grouped, e.where(f"ord % {SPAN} % 10 <> 0").select("id", (F.col("ord") % SPAN).alias("grp")))


@query(f"{_KEYED}{_SALES}{_CREDITS}{_PLACED}{_RAISED} SELECT count(*) labelled, count(*) FILTER (category = CASE source WHEN 'refund' THEN 'orphan_refund' WHEN 'bank' THEN 'fee_mismatch' ELSE 'missing_in_bank' END) hits FROM ex")
def category_accuracy(spark, sf):
    entries, linked, _, _ = _linked(spark, sf)
    truth = entries.select("id", F.when(F.col("source") == "refund", "orphan_refund").when(F.col("source") == "bank", "fee_mismatch").otherwise("missing_in_bank").alias("category"))
    return grp.category_accuracy(exc.classify_residual(_singles(linked), entries), truth)


# ---- worklist -------------------------------------------------------------------------------------

_FIRST, _SECOND = "k % 3 <> 0 AND d < DATE '1999-01-01'", "k % 5 <> 0"
_ITEMS = f""", i AS (SELECT 'pay_' || k entry_id, g amount, k, d, 'pay_' || k || '|missing_in_bank|' || g || '|' || cur fingerprint FROM base), r1 AS (SELECT * FROM i WHERE {_FIRST}), r2 AS (SELECT * FROM i WHERE {_SECOND}),
    w AS (SELECT coalesce(r2.fingerprint, r1.fingerprint) fingerprint, coalesce(r2.amount, r1.amount) amount, CASE WHEN r2.fingerprint IS NULL AND r1.k % 2 = 0 THEN 'resolved' ELSE 'open' END status, CASE WHEN r1.fingerprint IS NULL THEN 'r2' ELSE 'r1' END first_run,
      CAST(r1.fingerprint IS NOT NULL AS BIGINT) + CAST(r2.fingerprint IS NOT NULL AS BIGINT) times_seen, r1.fingerprint IS NULL fresh, r2.fingerprint IS NULL AND r1.k % 2 = 0 gone FROM r1 FULL JOIN r2 ON r1.fingerprint = r2.fingerprint)"""


def _two_runs(spark, sf):
    b = _base(spark, sf)
    own = F.concat(F.lit("pay_"), _text())

    def items(when):
        return b.where(when).select(
            own.alias("entry_id"), F.lit("payment").alias("source"), F.lit("missing_in_bank").alias("category"), F.col("g").alias("amount"), F.col("cur").alias("currency"), F.col("d").alias("value_date"), F.lit(0.6).alias("conf"), F.lit("unpaid").alias("rationale"),
            fn.exception_key(own, F.lit("missing_in_bank"), F.col("g"), F.col("cur")).alias("fingerprint"),
        )

    none = spark.createDataFrame([], worklist.ITEM)
    first, _ = worklist.merge(none, items(_FIRST), b.select(own.alias("id")), "r1")
    return worklist.merge(first, items(_SECOND), b.where("k % 2 = 0").select(own.alias("id")), "r2")


@query(f"{_ITEMS} SELECT fingerprint, status, first_run, times_seen FROM w")
def worklist_merge(spark, sf):
    return _two_runs(spark, sf)[0].select("fingerprint", "status", "first_run", "times_seen")


@query(f"{_ITEMS} SELECT fingerprint, CASE WHEN gone THEN 'auto_resolved' ELSE 'created' END AS event FROM w WHERE gone OR fresh")
def worklist_events(spark, sf):
    return _two_runs(spark, sf)[1].select("fingerprint", "event")


@query(f"{_ITEMS} SELECT fingerprint, amount FROM w WHERE status = 'open' AND amount >= 1000000 ORDER BY amount DESC, fingerprint LIMIT 50 OFFSET 10")
def worklist_page(spark, sf):
    return worklist.page(_two_runs(spark, sf)[0], "amount", True, 50, 10, status="open", min_amount=1000000).select("fingerprint", "amount")


@query(f"{_ITEMS} SELECT status, count(*) items, CAST(sum(amount) AS BIGINT) AS value, count(*) FILTER (times_seen > 1) carried FROM w GROUP BY 1")
def worklist_summary(spark, sf):
    return worklist.summary(_two_runs(spark, sf)[0]).select("status", "items", "value", "carried")


# ---- whole runs -----------------------------------------------------------------------------------


@query()
def reconcile_full(spark, sf):
    """Every rule, the resolver and the classifier over the derived batch: groups with stage, status and amount."""
    return Result(batch(spark, sf), Settings.of(spark)).groups.select(F.array_join("entry_ids", ",").alias("entry_ids"), "stage", F.array_join("rules", "+").alias("rules"), "confidence", "status", F.col("amount").cast("long").alias("amount"))


@query()
def reconcile_metrics(spark, sf):
    """Counts of a run that looks for subsets in pools of any size and counts all of them."""
    return Result(batch(spark, sf), replace(Settings.of(spark), pool=0)).metrics()


@query()
def reconcile_exceptions(spark, sf):
    return Result(batch(spark, sf), Settings.of(spark)).exceptions.select("id", "source", "category", "amount", "conf", "action")


# ---- refusals, proposals, reports -----------------------------------------------------------------


_OVERRIDE = {"rules": {"Card": {"fixed_minor": 300}, "upi": {"percent_bps": 150, "label": "UPI at last"}, "cheque": {"percent_bps": 50}, "netbanking": {"percent_bps": "much"}}, "tds_bps": 25}


@query(
    f""", m AS (SELECT k, g, lower(trim({_METHODS})) method FROM base), f AS (SELECT *, (2 * g * CASE method WHEN 'upi' THEN 150 WHEN 'netbanking' THEN 180 WHEN 'cheque' THEN 50 ELSE 200 END + 10000) // 20000 + CASE WHEN method = 'card' THEN 300 ELSE 0 END rule_fee FROM m)
    SELECT k, rule_fee, (2 * rule_fee * 1800 + 10000) // 20000 rule_tax, (2 * g * 25 + 10000) // 20000 rule_tds, CASE method WHEN 'upi' THEN 'UPI at last' WHEN 'netbanking' THEN 'netbanking' WHEN 'cheque' THEN 'cheque' WHEN 'card' THEN 'Card' ELSE 'default' END rule_label FROM f"""
)
def rate_card_override(spark, sf):
    """FN17: all orders priced by a card whose file gives some fields, names a new method, has a rule that can't be read, and withholds tax."""
    path = f"{shared_dir(spark)}/card-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps(_OVERRIDE),)], "value string").write.text(path)
    method = F.when(_k() % 5 == 0, "upi").when(_k() % 5 == 1, " Card").when(_k() % 5 == 2, "netbanking").when(_k() % 5 == 3, "cheque")
    sales = _base(spark, sf).select("k", F.col("g").alias("gross"), method.alias("method"))
    return fees.priced(sales, fees.rate_card(spark, path), tds_bps=fees.withheld(spark, path)).select("k", "rule_fee", "rule_tax", "rule_tds", "rule_label")


_DISPUTED = """, d AS (SELECT k, cur, g, CASE WHEN k % 38 = 0 THEN rf * 4 ELSE rf END taken, k % 95 = 0 AS foreign_, CASE WHEN k % 2 = 0 THEN 'chargeback' ELSE 'refund' END src FROM base WHERE k % 19 = 0 AND k % 57 <> 0)"""


@query(
    f"""{_DISPUTED} SELECT 'deduction-currency-mismatch@v1' AS rule, 'pay_' || k || ',rf_' || k inputs, 'rejected' outcome, 0.0::DOUBLE confidence, src || ' in EUR names a payment in ' || cur rationale FROM d WHERE foreign_
    UNION ALL SELECT 'over-refund@v1', 'pay_' || k, 'exception', 0.95, 'deductions exceed the payment by ' || CAST(taken - g AS BIGINT) FROM d WHERE NOT foreign_ AND taken > g"""
)
def refused_deductions(spark, sf):
    """JN2 to JN4 with chargebacks: deductions in another currency, and those that exceed their payment."""
    k = F.col("ord") % SPAN
    mine = F.col("source") == "refund"
    e = batch(spark, sf).withColumn("amount", F.when(mine & (k % 38 == 0), F.col("amount") * 4).otherwise(F.col("amount")))
    e = e.withColumn("currency", F.when(mine & (k % 95 == 0), "EUR").otherwise(F.col("currency"))).withColumn("source", F.when(mine & (k % 2 == 0), "chargeback").otherwise(F.col("source")))
    links = reference.deduction_links(reference.exact_reference(e))
    return reports.refusals(links, None, e).select("rule", F.array_join("inputs", ",").alias("inputs"), "outcome", F.col("confidence").cast("double").alias("confidence"), "rationale")


@query(
    f""", m AS (SELECT ord % {SPAN} grp, source, amount FROM entries), g AS (SELECT grp, count(*) members, CAST(coalesce(sum(amount) FILTER (source IN ('payment', 'ledger')), 0) AS BIGINT) gross,
      CAST(coalesce(sum(amount) FILTER (source IN ('settlement', 'bank')), 0) AS BIGINT) net, min(amount) low, max(amount) high FROM m GROUP BY 1),
    s AS (SELECT *, CASE WHEN gross = 0 OR net = 0 THEN high - low ELSE abs(gross - net) END gap, CASE WHEN gross = 0 OR net = 0 THEN high // 20 ELSE gross // 20 END part FROM g)
    SELECT grp, members, CAST(gap AS BIGINT) gap, members > 1 AND gap <= greatest(100, part) plausible FROM s"""
)
def plausible_groups(spark, sf):
    """PR9 asked of the entries of each order as one proposal."""
    return reports.plausible(batch(spark, sf).select((F.col("ord") % SPAN).alias("grp"), "source", "amount"))


@query(
    """, r AS (SELECT cur label, (k % 1000) / 1000.0 "precision", (k % 777) / 777.0 recall, (k % 501) / 501.0 f1, CASE WHEN k % 3 > 0 THEN (k % 11) / 11.0 END amr, g, k FROM base)
    SELECT label, count(*) runs, CAST(sum(k % 50) AS BIGINT) total_entries, round(avg("precision"), 4) precision_mean, round(min("precision"), 4) precision_worst, round(avg(recall), 4) recall_mean, round(min(f1), 4) f1_worst,
      round(avg(amr), 4) auto_match_rate_mean, CAST(sum(g) AS BIGINT) false_match_cost, bool_and(k % 2 = 0) all_replay_stable FROM r GROUP BY 1"""
)
def run_aggregate(spark, sf):
    """AG11 over made-up scores, one an order."""
    k = _k()
    scores = _base(spark, sf).select(
        F.col("cur").alias("label"), (k % 1000 / 1000.0).alias("precision"), (k % 777 / 777.0).alias("recall"), (k % 501 / 501.0).alias("f1"), F.when(k % 3 > 0, k % 11 / 11.0).alias("auto_match_rate"),
        F.lit(1.0).alias("category_accuracy"), F.lit(1.0).alias("value_precision"), F.lit(0.0).alias("resolver_share"), (k % 50).alias("entries"), F.col("g").alias("false_match_cost"), (k % 2 == 0).alias("replay_stable"),
    )
    return reports.run_summary(scores).select("label", "runs", "total_entries", "precision_mean", "precision_worst", "recall_mean", "f1_worst", "auto_match_rate_mean", "false_match_cost", "all_replay_stable")


_PARTS = {"reconciled": "payment", "in_transit": "settlement", "recoverable": "bank", "unrecorded": "ledger", "ambiguous": "chargeback"}


@query(
    """, p AS (SELECT currency, CASE source WHEN 'payment' THEN 'reconciled' WHEN 'settlement' THEN 'in_transit' WHEN 'bank' THEN 'recoverable' ELSE 'unrecorded' END bucket, CAST(sum(amount) AS BIGINT) amount FROM entries WHERE source <> 'refund' GROUP BY 1, 2)
    SELECT currency, bucket, amount, round(amount / sum(amount) OVER (PARTITION BY currency), 4) AS share FROM p WHERE amount > 0"""
)
def money_shares(spark, sf):
    """AG15 over what each source adds up to."""
    sums = [F.coalesce(F.sum(F.when(F.col("source") == s, F.col("amount"))), F.lit(0)).cast("long").alias(b) for b, s in _PARTS.items()]
    return reports.money_shares(batch(spark, sf).groupBy("currency").agg(*sums), ["currency"])


@query(" SELECT source category, count(*) n FROM entries GROUP BY 1 ORDER BY n DESC, category LIMIT 6")
def top_categories(spark, sf):
    return reports.top_categories(batch(spark, sf).withColumnRenamed("source", "category"))


# ---- branches that the derived batch doesn't reach ------------------------------------------------


def _text_of(c: str):
    return F.col(c).cast("string")


_TENTH = "CAST(g // 10 + 1 AS BIGINT)"


@query(
    f""" SELECT 'set_' || k id, 'settlement' source, g amount, d value_date, cur currency, 'UTR' || k reference, 'payout' narration, CAST(NULL AS VARCHAR) related, CASE WHEN k % 3 = 0 THEN 0 ELSE fee END fee, tax,
      CASE WHEN k % 4 = 0 THEN 7::BIGINT END tds, k % 3 <> 0 fee_reported, CAST(NULL AS VARCHAR) dispute FROM base
    UNION ALL SELECT 'bnk_' || k, 'bank', CASE WHEN k % 5 < 2 THEN -g ELSE g END, d, 'INR', CASE WHEN k % 2 = 0 THEN 'X' || k WHEN k % 3 = 0 THEN 'UTR' || (100000000 + k) END, CASE WHEN k % 3 = 0 THEN 'neft utr' || (100000000 + k) || ' in' ELSE 'cash' END, NULL, 0, 0, NULL, false, NULL FROM base
    UNION ALL SELECT 'led_' || k, 'ledger', g, d, CASE WHEN k % 9 = 0 THEN 'USD' ELSE 'INR' END, CASE WHEN k % 2 = 1 THEN 'R' || k WHEN k % 3 = 0 THEN 'ORD' || (1000000 + k) END, CASE WHEN k % 3 = 0 THEN 'for ORD' || (1000000 + k) ELSE 'sale' END, NULL, 0, 0, NULL, false, NULL FROM base
    UNION ALL SELECT 'rf_' || k, 'refund', {_TENTH}, d, cur, 'rf_' || k, 'processed', CASE WHEN k % 3 = 0 THEN 'ORD' || k ELSE 'pay_' || k END, 0, 0, NULL, false, NULL FROM base
    UNION ALL SELECT 'cb_' || k, 'chargeback', {_TENTH}, d, 'EUR', 'cb_' || k, ['Under Review', 'WON', 'debited', 'odd'][k % 4 + 1], 'pay_' || k, 0, 0, NULL, false, ['under_review', 'won', 'lost', NULL][k % 4 + 1] FROM base"""
)
def normalized_sources(spark, sf):
    """FN3 to FN8: exports of the five other sources through mapping, checks and normalising."""
    b = _base(spark, sf)
    k = lambda n, r=0: _k() % n == r
    named = lambda p: F.concat(F.lit(p), _text())
    day, amount, utr = F.date_format("d", "yyyy-MM-dd"), _text_of("g"), (_k() + 100_000_000).cast("string")
    taken = (F.call_function("div", F.col("g"), F.lit(10)) + 1).cast("string")
    order = F.concat(F.lit("ORD"), (_k() + 1_000_000).cast("string"))
    tables = {
        "settlement": {"Id": named("set_"), "Amount": amount, "Date": day, "Currency": F.col("cur"), "Fee": F.when(k(3), "").otherwise(_text_of("fee")), "Tax": _text_of("tax"), "TDS": F.when(k(4), "7").otherwise(""), "UTR": named("UTR")},
        "bank": {"Id": named("bnk_"), "Amount": amount, "Value Date": day, "Type": F.when(k(5), "DR").when(k(5, 1), " debit ").when(k(5, 2), "CR").otherwise(""), "UTR": F.when(k(2), named("X")).otherwise("-"), "Narration": F.when(k(3), F.concat(F.lit("neft utr"), utr, F.lit(" in"))).otherwise("cash")},
        "ledger": {"Id": named("led_"), "Amount": amount, "Date": day, "Currency": F.when(k(9), " usd").when(k(9, 1), "XYZ").otherwise("INR"), "Ref": F.when(k(2), "nan").otherwise(named("R")), "Description": F.when(k(3), F.concat(F.lit("for "), order)).otherwise("sale")},
        "refund": {"Id": named("rf_"), "Amount": F.concat(F.when(k(2), "-").otherwise(""), taken), "Date": day, "Currency": F.col("cur"), "Payment Id": F.when(k(3), " ").otherwise(named("pay_")), "Ref": named("ORD"), "Status": F.lit("processed")},
        "chargeback": {"Id": named("cb_"), "Amount": taken, "Date": day, "Currency": F.lit("EUR"), "Payment Id": named("pay_"), "Status": F.when(k(4), "Under Review").when(k(4, 1), "WON").when(k(4, 2), "debited").otherwise("odd")},
    }
    entries, _ = ingest.entries_of({s: b.select(*[c.alias(h) for h, c in columns.items()]) for s, columns in tables.items()})
    return entries.select("id", "source", "amount", "value_date", "currency", "reference", "narration", "related", "fee", "tax", "tds", "fee_reported", "dispute")


@query(
    """, r AS (SELECT k, k % 40 = 0 blank, k % 40 <> 0 AND k % 3 = 0 unnamed FROM base), n AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN unnamed THEN k // 60 ELSE -k - 1 END ORDER BY k) nth FROM r)
    SELECT k, blank empty, NOT blank accepted, unnamed AND nth > 1 exported_twice, NOT blank AND k % 5 = 0 no_payment FROM n"""
)
def quality_branches(spark, sf):
    """QV1, QV6, QV7: empty rows, rows without ids that were exported twice, refunds that name no payment."""
    blank, unnamed, group = _k() % 40 == 0, _k() % 3 == 0, F.call_function("div", _k(), F.lit(60)).cast("string")
    said = lambda c: F.when(blank, "").otherwise(c)
    rows = _base(spark, sf).select(
        _k().alias("_row"), said(F.when(unnamed, " ").otherwise(F.concat(F.lit("p"), _text()))).alias("id"), said(F.concat(group, F.lit("7"))).alias("amount"), F.lit(None).cast("double").alias("amount_major"),
        said(F.lit("2024-01-31")).alias("date"), said(F.lit("INR")).alias("currency"), said(F.concat(F.when(_k() % 2 == 0, "R").otherwise(" r"), group)).alias("reference"), F.lit(None).cast("string").alias("narration"),
        said(F.when(_k() % 5 == 0, "").otherwise("pay")).alias("payment_id"),
    )
    said_of = lambda p: F.exists("issues", lambda i: i.problem == p)
    return quality.assess(rows, "refund").select(F.col("_row").alias("k"), "empty", "accepted", said_of("exported twice").alias("exported_twice"), said_of("names no payment").alias("no_payment"))


@query(
    """, x AS (SELECT 'b' || k id, 'bank' source, g amount, d value_date, cur || (k // 500) AS currency, CASE WHEN k % 12 = 3 THEN 'paid ord' || k ELSE 'transfer' END narration, CASE k % 6 WHEN 0 THEN ' ord' || k WHEN 3 THEN 'UTR' || k END reference, k + 20000000000000 ord FROM base
      UNION ALL SELECT 'l' || k, 'ledger', g + (k % 3) * 50, d, cur || (k // 500), 'sale transfer', CASE WHEN k % 3 < 2 THEN 'ORD' || k END, k + 30000000000000 FROM base),
    z AS (SELECT a.id a_id, b.id b_id, a.source s, b.source t, abs(a.amount - b.amount) gap, abs(a.value_date - b.value_date) n_days, lower(a.narration) an, lower(b.narration) bn, lower(trim(a.reference)) ar, lower(trim(b.reference)) br, count(*) OVER (PARTITION BY a.id) n
      FROM x a JOIN x b ON a.currency = b.currency AND b.amount <= a.amount + greatest(2000, abs(a.amount) * 3 // 100) AND b.amount >= a.amount AND (b.amount > a.amount OR b.ord > a.ord)),
    y AS (SELECT *, coalesce(ar = br, false) OR coalesce(contains(bn, ar), false) OR coalesce(contains(an, br), false) AS echoed, list_distinct(regexp_extract_all(concat_ws(' ', an, ar), '[a-z0-9]{3,}')) ta, list_distinct(regexp_extract_all(concat_ws(' ', bn, br), '[a-z0-9]{3,}')) tb
      FROM z WHERE n <= 40 AND s <> t)
    SELECT a_id, b_id, CAST(floor(100 * (0.55 * CASE WHEN gap <= 2 THEN 1.0 ELSE 0.6 END + 0.2 * CASE WHEN n_days <= 3 THEN 1.0 WHEN n_days <= 7 THEN 0.6 ELSE 0.2 END + 0.15 * len(list_intersect(ta, tb)) / len(list_distinct(list_concat(ta, tb))) + CASE WHEN echoed THEN 0.1 ELSE 0 END) + 0.001) AS BIGINT) score
    FROM y WHERE ar IS NULL OR br IS NULL OR echoed"""
)
def referenced_pairs(spark, sf):
    """PR4, PR5: residual pairs with references: those that agree or are quoted score higher, those that contradict are refused."""
    b = _base(spark, sf).withColumn("cur", F.concat("cur", F.call_function("div", _k(), F.lit(500)).cast("string")))
    side = lambda p, source, amount, narration, reference, at: b.select(F.concat(F.lit(p), _text()).alias("id"), F.lit(source).alias("source"), amount.alias("amount"), F.col("d").alias("value_date"), F.col("cur").alias("currency"), narration.alias("narration"), reference.alias("reference"), (_k() + at * SPAN).alias("ord"))
    bank = side("b", "bank", F.col("g"), F.when(_k() % 12 == 3, F.concat(F.lit("paid ord"), _text())).otherwise("transfer"), F.when(_k() % 6 == 0, F.concat(F.lit(" ord"), _text())).when(_k() % 6 == 3, F.concat(F.lit("UTR"), _text())), 2)
    ledger = side("l", "ledger", F.col("g") + _k() % 3 * 50, F.lit("sale transfer"), F.when(_k() % 3 < 2, F.concat(F.lit("ORD"), _text())), 3)
    scored = resolver.score(resolver.candidate_pairs(as_entries(bank.unionByName(ledger))))
    return scored.select("a_id", "b_id", F.floor(F.col("score") * 100 + 0.001).alias("score"))


@query(
    """, w AS (SELECT k, g, cur, ['open', 'investigating', 'resolved', 'written_off'][k % 4 + 1] was, k % 3 = 0 raised, k % 3 <> 0 AND k % 2 = 0 AND k % 4 < 2 gone FROM base)
    SELECT 'pay_' || k || '|missing_in_bank|' || g || '|' || cur fingerprint, CASE WHEN raised AND was = 'resolved' THEN 'open' WHEN gone THEN 'resolved' ELSE was END status, CASE WHEN raised OR gone THEN 'r2' ELSE 'r1' END last_run, CAST(CASE WHEN raised THEN 2 ELSE 1 END AS BIGINT) times_seen FROM w"""
)
def worklist_reopen(spark, sf):
    """ST2: a second run over items in every state."""
    own = F.concat(F.lit("pay_"), _text())
    b = _base(spark, sf)
    items = b.select(
        "k", own.alias("entry_id"), F.lit("payment").alias("source"), F.lit("missing_in_bank").alias("category"), F.col("g").alias("amount"), F.col("cur").alias("currency"), F.col("d").alias("value_date"), F.lit(0.6).alias("conf"), F.lit("unpaid").alias("rationale"),
        fn.exception_key(own, F.lit("missing_in_bank"), F.col("g"), F.col("cur")).alias("fingerprint"),
    )
    first, _ = worklist.merge(spark.createDataFrame([], worklist.ITEM), items.drop("k"), b.select(own.alias("id")), "r1")
    k = F.substring_index("entry_id", "_", -1).cast("long")
    held = first.withColumn("status", F.when(k % 4 == 0, "open").when(k % 4 == 1, "investigating").when(k % 4 == 2, "resolved").otherwise("written_off"))
    merged, _ = worklist.merge(held, items.where("k % 3 = 0").drop("k"), b.where("k % 2 = 0").select(own.alias("id")), "r2")
    return merged.select("fingerprint", "status", "last_run", "times_seen")


@query(
    """, s AS (SELECT *, ['complete', 'payout_overdue', 'unbooked_payout', 'ambiguous_split', 'partial'][k % 5 + 1] status FROM base), q AS (SELECT 'bnk_' || k entry_id, 'bank' source, ['', 'missing_in_bank', 'missing_in_ledger', 'split_settlement', 'unknown'][k % 5 + 1] category, g, cur, d, 'bank+ledger: ' || status rationale FROM s WHERE status <> 'complete'
      UNION ALL SELECT 'pay_' || k, 'payment', 'missing_in_bank', g, cur, d, 'unpaid' FROM base WHERE k % 10 = 0)
    SELECT entry_id, source, category, g amount, d value_date, rationale, entry_id || '|' || category || '|' || g || '|' || cur fingerprint FROM q"""
)
def queue_items(spark, sf):
    """SO6, CL4: exceptions, and groups whose loop isn't closed under their first id."""
    b = _base(spark, sf)
    named = lambda p: F.concat(F.lit(p), _text())
    own = [F.col("g").alias("amount"), F.col("cur").alias("currency")]
    status = F.when(_k() % 5 == 0, "complete").when(_k() % 5 == 1, "payout_overdue").when(_k() % 5 == 2, "unbooked_payout").when(_k() % 5 == 3, "ambiguous_split").otherwise("partial")
    groups = b.select(F.array(named("led_"), named("bnk_")).alias("entry_ids"), F.array(F.lit("bank"), F.lit("ledger")).alias("sources"), *own, F.lit(0.9).alias("confidence"), status.alias("status"))
    raised = b.where("k % 10 = 0").select(named("pay_").alias("id"), F.lit("payment").alias("source"), F.lit("missing_in_bank").alias("category"), *own, F.col("d").alias("value_date"), F.lit(0.6).alias("conf"), F.lit("unpaid").alias("rationale"))
    legs = F.explode(F.array(F.struct(named("bnk_").alias("id"), F.lit("bank").alias("source"), _k().alias("ord")), F.struct(named("led_").alias("id"), F.lit("ledger").alias("source"), (_k() + SPAN).alias("ord")))).alias("e")
    entries = b.select("d", legs).select("e.*", F.col("d").alias("value_date"))
    return worklist.queue_items(raised, groups, entries).select("entry_id", "source", "category", "amount", "value_date", "rationale", "fingerprint")


# ---- SQL functions, records of uneven shape, searches past their budget ---------------------------


@query(
    """, t AS (SELECT k, g, cur, CASE k % 4 WHEN 0 THEN printf('%.2f', g / 100.0) WHEN 1 THEN CAST(g AS VARCHAR) WHEN 2 THEN '(' || printf('%.2f', g / 100.0) || ')' ELSE 'n/a' END s, CASE WHEN k % 2 = 0 THEN strftime(d, '%d/%m/%Y') ELSE 'soon' END dd, d FROM base),
    v AS (SELECT *, CASE k % 4 WHEN 2 THEN -g WHEN 3 THEN 0 ELSE g END minor, CAST(abs(g) // 100 AS VARCHAR) w, lpad(CAST(g % 100 AS VARCHAR), 2, '0') c FROM t)
    SELECT k, minor, CASE WHEN k % 2 = 0 THEN d ELSE DATE '1970-01-01' END AS "day", CAST(CASE WHEN k % 3 = 0 THEN -((2 * g + 7) // 14) ELSE (2 * g + 7) // 14 END AS BIGINT) seventh,
      CASE WHEN cur = 'INR' THEN '₹' || CASE WHEN length(w) <= 3 THEN w ELSE ltrim(reverse(regexp_replace(reverse(left(w, length(w) - 3)), '(\\d\\d)', '\\1,', 'g')), ',') || ',' || right(w, 3) END
        ELSE '$' || ltrim(reverse(regexp_replace(reverse(w), '(\\d\\d\\d)', '\\1,', 'g')), ',') END || '.' || c money FROM v"""
)
def sql_functions(spark, sf):
    """FN1, FN2, FN10 and FN13 in plain SQL over ``orders``."""
    sql.register(spark)
    _base(spark, sf).createOrReplaceTempView("tieout_base")
    return spark.sql("""
        SELECT k, parse_minor(CASE k % 4 WHEN 0 THEN format_string('%.2f', g / 100) WHEN 1 THEN CAST(g AS STRING) WHEN 2 THEN '(' || format_string('%.2f', g / 100) || ')' ELSE 'n/a' END) AS minor,
          parse_day(CASE WHEN k % 2 = 0 THEN date_format(d, 'dd/MM/yyyy') ELSE 'soon' END) AS day, divide_half_away(g, CASE WHEN k % 3 = 0 THEN -7L ELSE 7L END) AS seventh, format_money(g, cur) AS money
        FROM tieout_base""")


def _pages(rows: DataFrame, record) -> DataFrame:
    """Pages of 50 records as a gateway answers them: ``items``, ``rows`` or a plain array."""
    page = F.call_function("div", _k(), F.lit(50))
    held = rows.select(page.alias("page"), F.struct(_k().alias("k"), record.alias("json")).alias("r")).groupBy("page").agg(F.sort_array(F.collect_list("r")).alias("rs"))
    array = F.concat(F.lit("["), F.array_join("rs.json", ","), F.lit("]"))
    wrapped = F.when(F.col("page") % 3 == 0, F.concat(F.lit('{"items":'), array, F.lit("}"))).when(F.col("page") % 3 == 1, F.concat(F.lit('{"count":50,"rows":'), array, F.lit("}"))).otherwise(array)
    return held.select(wrapped.alias("value"))


@query(
    """ SELECT 'pay_' || k id, 'payment' source, g amount, d value_date, cur currency, CASE WHEN k % 4 = 0 THEN 'pay_' || k ELSE 'ORD' || k END reference, CASE WHEN k % 3 = 0 THEN 'card' END AS method, CASE WHEN k % 3 = 0 THEN fee ELSE 0 END fee, CAST(NULL AS VARCHAR) related FROM base WHERE k % 5 <> 0 AND k % 11 <> 0
    UNION ALL SELECT 'rfnd_' || k, 'refund', g // 10 + 1, d, cur, 'rfnd_' || k, NULL, 0, 'pay_' || k FROM base"""
)
def gateway_entries(spark, sf):
    """SC9, SC2, QV1: pages of API-shaped payments and refunds of uneven shape: uncaptured ones, absent fields, and things that are no records."""
    b = _base(spark, sf)
    seconds = F.unix_timestamp(F.col("d").cast("timestamp")) + 37_800
    payment = F.to_json(F.struct(
        F.concat(F.lit("pay_"), _text()).alias("id"), F.col("g").alias("amount"), F.col("cur").alias("currency"), seconds.alias("created_at"), F.when(_k() % 5 == 0, "authorized").otherwise("captured").alias("status"),
        F.when(_k() % 2 == 0, _k() % 5 != 0).alias("captured"), F.when(_k() % 4 != 0, F.concat(F.lit("ORD"), _text())).alias("order_id"), F.when(_k() % 3 == 0, "card").alias("method"), F.when(_k() % 3 == 0, F.col("fee")).alias("fee"),
        F.struct(F.lit("web").alias("channel")).alias("notes"),
    ))
    payment = F.when(_k() % 11 == 0, F.when(_k() % 2 == 0, "17").otherwise('"torn"')).otherwise(payment)
    refund = F.to_json(F.struct(F.concat(F.lit("rfnd_"), _text()).alias("id"), (F.call_function("div", F.col("g"), F.lit(10)) + 1).alias("amount"), F.col("cur").alias("currency"), F.concat(F.lit("pay_"), _text()).alias("payment_id"), seconds.alias("created_at")))
    entries, _ = gateway.entries_of({"payment": _pages(b, payment), "refund": _pages(b, refund)})
    return entries.select("id", "source", "amount", "value_date", "currency", "reference", "method", "fee", "related")


@query(
    """, t AS (SELECT k, k % 13 = 0 AS broken, k % 13 <> 0 AND k % 7 = 0 AS blank, k % 3 = 0 undated FROM base)
    SELECT CASE WHEN broken THEN 'not a record' WHEN blank THEN 'empty' WHEN undated THEN 'no date' ELSE 'accepted' END verdict, count(*) n FROM t GROUP BY 1"""
)
def torn_records(spark, sf):
    """QV1, SC1: lines that should be JSON objects: broken ones, numbers and lists are quarantined as no records, blank records are counted."""
    own = F.to_json(F.struct(F.concat(F.lit("p"), _text()).alias("Payment Id"), F.col("g").alias("Amount"), F.when(_k() % 3 != 0, F.date_format("d", "yyyy-MM-dd")).alias("Created At")))
    line = F.when(_k() % 39 == 0, "[1, 2]").when(_k() % 26 == 0, "12").when(_k() % 13 == 0, F.substring(own, 1, 15)).when(_k() % 7 == 0, '{"Amount": " "}').otherwise(own)
    rows = ingest.json_records(_base(spark, sf).select(F.try_parse_json(line).alias("record")))
    assessed = ingest.prepare(rows, "payment")
    first = F.get("issues", F.lit(0))
    verdict = F.when(F.col("accepted"), "accepted").when(F.col("empty"), "empty").when(first.problem == "not a record", "not a record").when(first.field == "date", "no date").otherwise(first.problem)
    return assessed.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query()
def subsets_past_budget(spark, sf):
    """JN12: days of 48 sales, and a payout of three or four of them: more subsets than the budget, of which the first ones count."""
    b = _base(spark, sf).withColumn("b", F.call_function("div", _k(), F.lit(48)))
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("b") % 10_000 * 5).cast("int"))
    rows = b.withColumn("value_date", day).withColumn("currency", F.concat(F.lit("C"), F.call_function("div", F.col("b"), F.lit(10_000)).cast("string")))
    parts = rows.select(F.concat(F.lit("part_"), _text()).alias("id"), F.lit("payment").alias("source"), F.col("g").alias("amount"), "value_date", "currency", F.concat(F.lit("P"), _text()).alias("reference"), _k().alias("ord"))
    chosen = (_k() % 48).isin(3, 17, 31) | (F.col("b") % 2 == 0) & (_k() % 48 == 40)
    whole = rows.where(chosen).groupBy("b", "value_date", "currency").agg(F.sum("g").alias("amount"))
    whole = whole.select(F.concat(F.lit("whole_"), F.col("b").cast("string")).alias("id"), F.lit("settlement").alias("source"), "amount", F.date_add("value_date", 2).alias("value_date"), "currency", (F.col("b") + SPAN).alias("ord"))
    clustered, _ = cluster(as_entries(parts.unionByName(whole, allowMissingColumns=True).withColumns({"fee": F.lit(0), "tax": F.lit(0)})))
    links, _ = settlement.link_settlements(cut(clustered.drop("prev_id"), "clustered"))
    return links.where("rule = 'split-settlement@v1'").select((F.col("anchor") - SPAN).alias("b"), "unit")


# ---- the whole engine, held against what was planted ----------------------------------------------

_PLANTED = """, p AS (SELECT k, g, k % 8 s, 'pay_' || k pay, 'set_' || k set_, 'bnk_' || k bnk, 'led_' || k led FROM base)"""


def _planted(spark, sf):
    """Every order one of eight situations, 200 days and, every 160 orders, a currency apart from the others (more of one currency would crowd the resolver's windows).

    0 a sale, paid out and credited; 1 two sales in one payout; 2 the same ledger row twice; 3 a chargeback before the payout, lost or, of every other order, still open;
    4 two equal sales and one payout; 5 a payout 30 days late; 6 a refund of nothing and a ledger row; 7 a credit and a ledger row without references.
    """
    b = _base(spark, sf)
    s, k = _k() % 8, _text()
    day = F.date_add(F.lit("2000-01-01").cast("date"), (_k() % 160 * 200).cast("int"))
    at = lambda n: F.date_add(day, n)

    def leg(when, source, id_, amount, date, reference=None, narration=None, related=None, dispute=None, nth=0):
        none = F.lit(None).cast("string")
        return F.when(when, F.struct(
            F.lit(source).alias("source"), id_.alias("id"), amount.cast("long").alias("amount"), date.alias("value_date"), (none if reference is None else reference).alias("reference"), (none if narration is None else narration).alias("narration"),
            (none if related is None else related).alias("related"), (none if dispute is None else dispute).alias("dispute"), (F.lit(nth * SPAN) + _k()).alias("ord"),
        ))

    named = lambda prefix, suffix="": F.concat(F.lit(prefix), k, F.lit(suffix))
    g, part, lost = F.col("g"), F.call_function("div", F.col("g"), F.lit(3)) + 1, F.call_function("div", F.col("g"), F.lit(4))
    contested = (s == 3) & (_k() % 16 == 11)  # still open, so nothing was taken
    paid = F.when((s == 3) & ~contested, g - lost).otherwise(g)
    when = F.when(s == 5, at(30)).otherwise(at(2))
    legs = F.array(
        leg(~s.isin(6, 7), "payment", named("pay_"), F.when(s == 1, part).otherwise(g), day, named("ORD")),
        leg(s.isin(1, 4), "payment", named("pay_", "b"), F.when(s == 1, g - part).otherwise(g), day, named("ORD", "b"), nth=1),
        leg(~s.isin(6, 7), "settlement", named("set_"), paid, when, named("UTR"), nth=2),
        leg(~s.isin(6, 7), "bank", named("bnk_"), paid, when, named("UTR"), nth=3),
        leg(s == 7, "bank", named("bnk_"), g, at(1), narration=named("acme", " invoice"), nth=3),
        leg(s.isin(0, 2), "ledger", named("led_"), g, day, named("ORD"), nth=4),
        leg(s == 2, "ledger", named("led_", "b"), g, day, named("ORD"), nth=5),
        leg(s.isin(6, 7), "ledger", named("led_"), g, day, narration=F.when(s == 6, named("other")).otherwise(F.concat(F.lit("invoice acme"), k)), nth=4),
        leg(s == 3, "chargeback", named("cb_"), lost, at(1), named("cb_"), related=named("pay_"), dispute=F.when(contested, "open").otherwise("lost"), nth=6),
        leg(s == 6, "refund", named("rf_"), g, day, named("rf_"), related=F.lit("nothing"), nth=6),
    )
    currency = F.concat(F.lit("C"), F.call_function("div", _k(), F.lit(160)).cast("string"))
    rows = b.select(currency.alias("currency"), F.explode(legs).alias("e")).where("e is not null").select("e.*", "currency")
    return as_entries(rows.withColumns({"fee": F.lit(0), "tax": F.lit(0)}))


@query(
    f"""{_PLANTED}, x AS (SELECT *, CASE s WHEN 0 THEN bnk || ',' || led || ',' || pay || ',' || set_ WHEN 1 THEN bnk || ',' || pay || ',' || pay || 'b,' || set_ WHEN 2 THEN bnk || ',' || led || ',' || pay || ',' || set_
        WHEN 3 THEN bnk || ',cb_' || k || ',' || pay || ',' || set_ WHEN 4 THEN bnk || ',' || set_ WHEN 5 THEN bnk || ',' || pay || ',' || set_ WHEN 7 THEN bnk || ',' || led END entry_ids FROM p WHERE s <> 6)
    SELECT entry_ids, CASE s WHEN 4 THEN 'deterministic' WHEN 7 THEN 'heuristic' ELSE 'structural' END stage,
      CASE s WHEN 1 THEN 'exact-reference@v2+split-settlement@v1' WHEN 3 THEN 'chargeback-to-payment@v1+exact-reference@v2+payment-to-settlement@v1' WHEN 4 THEN 'exact-reference@v2' WHEN 5 THEN 'exact-reference@v2+late-payout@v1'
        WHEN 7 THEN 'heuristic-pair@v1' ELSE 'exact-reference@v2+payment-to-settlement@v1' END rules,
      CAST(CASE s WHEN 1 THEN 92 WHEN 4 THEN 100 WHEN 5 THEN 90 WHEN 7 THEN 90 ELSE 98 END AS BIGINT) confidence, CASE s WHEN 4 THEN 'unbooked_payout' ELSE 'complete' END status, g amount, left(CASE s WHEN 7 THEN 'H' ELSE 'G' END, 1) series FROM x"""
)
def reconcile_planted(spark, sf):
    """Every rule, the resolver and the classifier over all orders, one planted situation each: the groups."""
    g = Result(_planted(spark, sf), Settings.of(spark)).groups
    return g.select(
        F.array_join("entry_ids", ",").alias("entry_ids"), "stage", F.array_join("rules", "+").alias("rules"), F.round(F.col("confidence") * 100).cast("long").alias("confidence"), "status", F.col("amount").cast("long").alias("amount"), F.substring("group_id", 1, 1).alias("series")
    )


@query(
    f"""{_PLANTED} SELECT led || 'b' id, 'ledger' source, 'duplicate' category, g amount FROM p WHERE s = 2 UNION ALL SELECT pay, 'payment', 'missing_in_bank', g FROM p WHERE s = 4 UNION ALL SELECT pay || 'b', 'payment', 'missing_in_bank', g FROM p WHERE s = 4
    UNION ALL SELECT 'rf_' || k, 'refund', 'orphan_refund', g FROM p WHERE s = 6
    UNION ALL SELECT led, 'ledger', CASE WHEN EXISTS (SELECT 1 FROM (SELECT CASE WHEN s = 3 AND k % 16 <> 11 THEN g - g // 4 ELSE g END amount FROM p WHERE s <> 6) o, (VALUES (-1), (0), (1)) w(w) WHERE o.amount // 201 = r.g // 201 + w.w AND abs(o.amount - r.g) <= 100) THEN 'amount_mismatch' ELSE 'missing_in_bank' END, g FROM p r WHERE s = 6"""
)
def reconcile_planted_exceptions(spark, sf):
    """The same run's exceptions."""
    return Result(_planted(spark, sf), Settings.of(spark)).exceptions.select("id", "source", "category", F.col("amount").cast("long").alias("amount"))


@query(f"""{_PLANTED} SELECT 'ambiguous-single@v1' AS rule, pay || ',' || pay || 'b,' || set_ inputs, 'structural' AS stage, 'exception' outcome FROM p WHERE s = 4""")
def reconcile_planted_refusals(spark, sf):
    """The same run's refusals: two sales that one payout may have paid."""
    return Result(_planted(spark, sf), Settings.of(spark)).refused.select("rule", F.array_join("inputs", ",").alias("inputs"), "stage", "outcome")
