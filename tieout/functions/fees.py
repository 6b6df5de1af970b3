"""Rate card and settlement equation."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions.scalars import divide_half_away, format_money, rate_of

# Method, basis points, flat part, tax on the fee in basis points, label.
CARD = [
    ("upi", 0, 0, 1800, "UPI (zero MDR)"),
    ("netbanking", 180, 0, 1800, "netbanking"),
    ("card", 200, 0, 1800, "domestic card"),
    ("card_intl", 300, 0, 1800, "international card"),
    ("wallet", 200, 0, 1800, "wallet"),
    ("emi", 300, 0, 1800, "EMI"),
    ("default", 200, 0, 1800, "default"),
]


def _file(spark: SparkSession, path: str) -> dict:
    """A rate card's JSON object, a few lines; empty where there is no such file or it holds no object."""
    try:
        given = json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))
    except (AnalysisException, ValueError):
        return {}
    return given if isinstance(given, dict) else {}


def withheld(spark: SparkSession, path: str | None = None) -> int:
    """FN17: basis points of tax that a card's file says are withheld; 0 where it doesn't."""
    given = _file(spark, path).get("tds_bps", 0) if path else 0
    try:
        return int(given)
    except (TypeError, ValueError):
        return 0


def rate_card(spark: SparkSession, path: str | None = None) -> DataFrame:
    """FN17: the card with a JSON file's rules over it; absent fields are those of the card's rule for that method
    (0, 0 and 18 % for a new method), an absent label is the method's name.

    A rule that can't be read leaves the card's; so does a file that isn't JSON.
    """
    fields = ("percent_bps", "fixed_minor", "tax_bps", "label")
    rules = {r[0]: dict(zip(fields, r[1:])) for r in CARD}
    if path:
        given = _file(spark, path).get("rules", {})
        for name, rule in given.items() if isinstance(given, dict) else ():
            method = name.strip().lower()
            base = {**rules.get(method, {"percent_bps": 0, "fixed_minor": 0, "tax_bps": 1800}), "label": name}
            try:
                rules[method] = {f: (str if f == "label" else int)(rule.get(f, base[f])) for f in fields}
            except (AttributeError, TypeError, ValueError):
                continue
    rules = {m: (m, *(r[f] for f in fields)) for m, r in rules.items()}
    return spark.createDataFrame(list(rules.values()), "method string, percent_bps long, fixed_minor long, tax_bps long, label string")


def priced(sales: DataFrame, card: DataFrame, method: str = "method", gross: str = "gross", tds_bps: int = 0) -> DataFrame:
    """FN14 to FN16: ``sales`` with rule_fee, rule_tax, rule_tds and label; an unknown method takes the default rule."""
    known = card.select(F.col("method").alias("_m"), "percent_bps", "fixed_minor", "tax_bps", "label")
    rows = sales.withColumn("_key", F.lower(F.trim(F.coalesce(F.col(method), F.lit("")))))
    rest = known.where("_m = 'default'").select(*[F.col(c).alias(f"d_{c}") for c in ("percent_bps", "fixed_minor", "tax_bps", "label")])
    rows = rows.join(F.broadcast(known), rows["_key"] == known["_m"], "left").join(F.broadcast(rest), F.lit(True), "left")  # one row
    pick = lambda c, none: F.coalesce(c, f"d_{c}", F.lit(none))
    fee = rate_of(F.col(gross), pick("percent_bps", 0)) + pick("fixed_minor", 0)
    out = rows.withColumn("rule_fee", fee).withColumn("rule_tax", divide_half_away(F.col("rule_fee") * pick("tax_bps", 0), 10_000))
    out = out.withColumn("rule_tds", rate_of(F.col(gross), F.lit(tds_bps))).withColumn("rule_label", pick("label", "none"))
    return out.select(*sales.columns, "rule_fee", "rule_tax", "rule_tds", "rule_label")


def equation(gross: Column, fee: Column, tax: Column, tds: Column, refunds: Column, chargebacks: Column, adjustment: Column) -> Column:
    """FN18."""
    return gross - fee - tax - tds - refunds - chargebacks + adjustment


def breakdown(rows: DataFrame) -> DataFrame:
    """FN19, FN20: priced rows with what was reported before what the card says, provenance, net, and how it comes about as steps and as a line.

    Expects gross, reported_fee, reported_tax, reported_tds (null: not reported), refunds, chargebacks and currency.
    """
    said = F.col("reported_fee").isNotNull()
    out = rows.withColumn("fee", F.coalesce("reported_fee", "rule_fee")).withColumn("tax", F.coalesce("reported_tax", "rule_tax")).withColumn("tds", F.coalesce("reported_tds", "rule_tds"))
    out = out.withColumn("provenance", F.when(said, "actual").otherwise("estimated"))
    out = out.withColumn("net", equation(*(F.col(c) for c in ("gross", "fee", "tax", "tds", "refunds", "chargebacks")), F.lit(0)))
    money = lambda c: format_money(F.col(c), F.col("currency"))
    parts = [("fee", "fee"), ("tax", "tax on the fee"), ("tds", "tax withheld"), ("refunds", "refunds"), ("chargebacks", "chargebacks")]
    taken = [F.when(F.col(c) != 0, F.concat(F.lit(f"less {said}: "), money(c))) for c, said in parts]
    out = out.withColumn("steps", F.array_compact(F.array(F.concat(F.lit("gross: "), money("gross")), *taken, F.concat(F.lit("net: "), money("net"), F.when(F.col("provenance") == "actual", F.lit("")).otherwise(F.lit(" (by the rate card)"))))))
    return out.withColumn("line", F.concat(money("gross"), F.lit(" - fee "), money("fee"), F.lit(" - tax "), money("tax"), F.lit(" = "), money("net")))
