"""Components as reconciliation units: gross, net, deductions, dates and references of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.schema import DEDUCTIONS
from tieout.tables import by_shuffle, cut


def _non_zero(c: Column) -> Column:
    return F.when(c != 0, c)


def settled() -> Column:
    """PR2: a deduction that reduces a payout."""
    state = F.coalesce(F.col("dispute"), F.lit("lost"))
    return (F.col("source") == "refund") | (F.col("source") == "chargeback") & state.isin("lost", "accepted")


def units(clustered: DataFrame) -> DataFrame:
    """AG1, AG3: one row a component, by one aggregation."""
    of = lambda s, c: F.sum(F.when(F.col("source") == s, F.col(c)))
    dates = lambda s: F.array_sort(F.collect_set(F.when(F.col("source") == s, F.col("value_date"))))
    lead = lambda c: F.min_by(c, "ord")
    u = clustered.groupBy("comp").agg(
        lead("currency").alias("currency"), lead("id").alias("first_id"), F.min("ord").alias("ord"), F.count("*").alias("members"), F.max("amount").alias("largest"),
        of("payment", "amount").alias("pay"), of("ledger", "amount").alias("led"), of("settlement", "amount").alias("setl"), of("bank", "amount").alias("bank"),
        F.sum(F.when(F.col("source").isin(DEDUCTIONS), F.col("amount"))).alias("all_deductions"),
        F.collect_list(F.when(F.col("source").isin(DEDUCTIONS) & settled(), F.struct("value_date", "amount"))).alias("events"),
        dates("payment").alias("pay_dates"), dates("settlement").alias("setl_dates"), F.collect_set("value_date").alias("dates"),
        F.max("value_date").alias("last_date"), F.collect_set(F.lower(F.trim("reference"))).alias("refs"), F.array_sort(F.collect_set("source")).alias("sources"),
    )
    base = F.coalesce(_non_zero(F.col("pay")), _non_zero(F.col("led")), F.col("largest"))
    u = u.withColumn("base_gross", base).withColumn("net", F.coalesce(_non_zero(F.col("setl")), _non_zero(F.col("bank")), F.col("largest")))
    return u.withColumn("gross", F.col("base_gross") - F.aggregate("events", F.lit(0).cast("long"), lambda s, e: s + e.amount))


def sale_units(clustered: DataFrame) -> DataFrame:
    """AG1 for payout links: components with a sale or a payout but not both (``sold`` tells which), entries of one having one currency.

    Sums and bounds of all components come first. Dates and deductions are gathered of those alone that have
    several, the others' follow from their bounds.
    """
    is_, deduction = lambda s: F.col("source") == s, F.col("source").isin(DEDUCTIONS) & settled()
    u = clustered.groupBy("comp", "currency").agg(
        F.min("ord").alias("ord"), F.max("amount").alias("largest"), F.sum(F.when(is_("payment"), F.col("amount"))).alias("pay"), F.sum(F.when(is_("ledger"), F.col("amount"))).alias("led"),
        F.bool_or(is_("payment")).alias("sold"), F.bool_or(is_("settlement")).alias("paid"), F.min("value_date").alias("low"), F.max("value_date").alias("high"), F.bool_or(deduction).alias("deducted"),
    )
    u = cut(u.where("sold <> paid").drop("paid"), "sold")
    several = u.where("sold and (deducted or low <> high)").select("comp")
    gathered = clustered.join(by_shuffle(several), "comp", "left_semi").groupBy("comp").agg(
        F.collect_list(F.when(deduction, F.struct("value_date", "amount"))).alias("events"), F.array_sort(F.collect_set(F.when(is_("payment"), F.col("value_date")))).alias("pay_dates"), F.collect_set("value_date").alias("dates"),
    )
    rows = u.join(by_shuffle(gathered), "comp", "left")
    one = F.array("low")
    rows = rows.withColumns({"events": F.coalesce("events", F.array().cast("array<struct<value_date:date,amount:bigint>>")), "pay_dates": F.coalesce("pay_dates", one), "dates": F.coalesce("dates", one)})
    rows = rows.withColumn("base_gross", F.coalesce(_non_zero(F.col("pay")), _non_zero(F.col("led")), F.col("largest")))
    gross = F.col("base_gross") - F.aggregate("events", F.lit(0).cast("long"), lambda s, e: s + e.amount)
    return rows.withColumn("gross", gross).select("comp", "currency", "ord", "sold", "base_gross", "gross", "events", "pay_dates", "dates")


def gross_as_of(when: Column, base: str = "base_gross", events: str = "events") -> Column:
    """AG2: gross less the deductions that had happened by a date."""
    return F.col(base) - F.aggregate(F.filter(F.col(events), lambda e: e.value_date <= when), F.lit(0).cast("long"), lambda s, e: s + e.amount)


def has(source: str) -> Column:
    return F.array_contains("sources", source)


def payout_units(clustered: DataFrame) -> DataFrame:
    """AG1 for bank links: components with a payout or a bank entry but not both, those that have both are done.

    Which they are is told by two flags first, so that dates and references are gathered of the open ones only.
    """
    flags = clustered.where(F.col("source").isin("settlement", "bank")).groupBy("comp").agg(F.bool_or(F.col("source") == "settlement").alias("paid"), F.bool_or(F.col("source") == "bank").alias("credited"))
    rows = clustered.join(by_shuffle(flags.where("paid <> credited")), "comp")
    of = lambda s, c: F.when(F.col("source") == s, F.col(c))
    u = rows.groupBy("comp", "paid").agg(
        F.min_by("currency", "ord").alias("currency"), F.min("ord").alias("ord"), F.max("amount").alias("largest"), F.sum(of("settlement", "amount")).alias("setl"), F.sum(of("bank", "amount")).alias("bank"),
        F.array_sort(F.collect_set(of("settlement", "value_date"))).alias("setl_dates"), F.collect_set("value_date").alias("dates"), F.collect_set(F.lower(F.trim("reference"))).alias("refs"),
    )
    return u.withColumn("net", F.coalesce(_non_zero(F.col("setl")), _non_zero(F.col("bank")), F.col("largest")))
