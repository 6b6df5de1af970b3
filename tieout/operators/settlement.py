"""Linking payouts to payments, and bank credits to payouts, by amount identities in date windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.conf import Settings
from tieout.operators.reference import references_contradict
from tieout.operators.solver import assign_all, assign_subsets, one_of_alike, unique_links
from tieout.operators.units import gross_as_of, payout_units, sale_units
from tieout.tables import by_shuffle, cut

#: Minor units of a join bucket of amounts.
BUCKET = 16


def settlement_target() -> Column:
    """JN5: what a payout paid out, from its own reported parts."""
    return F.col("amount") + F.col("fee") + F.col("tax") + F.coalesce("tds", F.lit(0))


def _bucket(c: Column) -> Column:
    return F.floor(c / BUCKET)


def _anchored(entries: DataFrame, open_: DataFrame, target: Column) -> DataFrame:
    """Entries of open components."""
    rows = entries.join(by_shuffle(open_.select("comp")), "comp", "left_semi")
    return rows.select(F.col("ord").alias("anchor"), F.col("id").alias("anchor_id"), "comp", "currency", "value_date", "reference", target.alias("target"))


def _window(anchors: DataFrame, shift: int) -> DataFrame:
    day = F.explode(F.sequence(F.date_add("value_date", -shift - 1), F.date_add("value_date", 1 - shift)))
    return anchors.withColumn("day", day)


def _near(anchors: DataFrame, pool: DataFrame, shift: int, slack: int) -> DataFrame:
    """Pairs of anchors and units of one currency in the window whose amounts are within ``slack``: an equi-join."""
    probe = _window(anchors, shift).withColumn("bucket", F.explode(F.array_distinct(F.array(_bucket(F.col("target") - slack), _bucket(F.col("target") + slack)))))
    pairs = probe.join(by_shuffle(pool).withColumn("bucket", _bucket(F.col("value"))), ["currency", "day", "bucket"])
    return pairs.where(F.abs(F.col("value") - F.col("target")) <= slack).drop("day", "bucket").dropDuplicates(["anchor", "unit"])


def _seen(free: DataFrame, days: str, shift: int, value) -> DataFrame:
    """Units (unit, uord, currency, dates, ...) by each window of three days, known by its first, that a day of theirs lies in.

    A window belongs to payouts of one date, ``start + shift + 1``; ``value`` gives a unit's amount as of it.
    """
    starts = F.array_distinct(F.flatten(F.transform(days, lambda d: F.sequence(F.date_sub(d, 2), d))))
    rows = free.withColumn("start", F.explode(starts)).withColumn("value", value(F.date_add("start", shift + 1)))
    first = F.array_min(F.filter(days, lambda d: d.between(F.col("start"), F.date_add("start", 2))))
    return rows.select("currency", "start", "value", first.alias("first"), "uord", "unit", F.array_sort("dates").alias("days"))


def _pools(anchors: DataFrame, seen: DataFrame, settings: Settings) -> DataFrame:
    """(anchor, target, pool): units that a subset may use, for anchors that have two to ``settings.pool`` of them.

    Usable are all amounts from 1 to the target, the smallest of a window, so the first few of each window
    tell both which anchors have too many and what the others' pools hold. Spark keeps those few before it
    shuffles; an anchor meets one row.
    """
    smallest = F.row_number().over(Window.partitionBy("currency", "start").orderBy("value", "uord"))
    few = seen.where("value > 0").withColumn("nth", smallest).where(F.col("nth") <= settings.pool + 1)
    unit = F.struct("first", "uord", "unit", F.col("value").alias("amount"), "days")
    held = few.groupBy("currency", "start").agg(F.sort_array(F.collect_list(unit)).alias("held"))
    pools = anchors.join(by_shuffle(held), ["currency", "start"]).select("anchor", "target", F.filter("held", lambda u: u.amount <= F.col("target") + settings.slack).alias("pool"))
    return pools.where(F.size("pool").between(2, settings.pool))


def _subsets(anchors: DataFrame, seen: DataFrame, most: int, settings: Settings) -> DataFrame:
    """(anchor, unit, decided): subsets of two to ``most`` units assigned to anchors; of all units and subsets where ``settings.pool`` is 0."""
    if not settings.pool:
        return assign_all(anchors, seen, most, settings.slack)
    return assign_subsets(_pools(anchors, seen, settings), most, settings.slack, settings.pool, settings.candidates, settings.combinations)


def _singles(anchors: DataFrame, seen: DataFrame) -> DataFrame:
    """(anchor, target, ..., n, unit): anchors with a unit of exactly their target in their window, how many there are, and the first."""
    alike = seen.groupBy("currency", "start", F.col("value").alias("target")).agg(F.count("*").alias("n"), F.min("unit").alias("unit"))
    return anchors.select("anchor", "currency", "start", "target").join(by_shuffle(alike), ["currency", "start", "target"])


def _ambiguous_singles(singles: DataFrame, seen: DataFrame, settings: Settings) -> DataFrame:
    """(anchor, unit) of anchors with several exact units.

    Of more than ``settings.pool`` (60 where it is 0) alike units each is named once, by the first of their anchors, and the
    other anchors name the first unit; else n anchors would name n units each.
    """
    key = ["currency", "start", "target"]
    units_ = seen.select("currency", "start", F.col("value").alias("target"), F.col("unit").alias("each"))
    crowd = settings.pool or Settings.pool
    few = singles.where(F.col("n").between(2, crowd)).join(units_, key).select("anchor", F.col("each").alias("unit"))
    many = singles.where(F.col("n") > crowd)
    heads = many.groupBy(*key).agg(F.min("anchor").alias("anchor")).join(units_, key).select("anchor", F.col("each").alias("unit"))
    return few.unionByName(heads).unionByName(many.select("anchor", "unit")).distinct()


def relabel(clustered: DataFrame, links: DataFrame, source: str | None = None) -> DataFrame:
    """Components after linking units (comp) to anchors' components: stars, so one lookup. source: that of all anchors, if it is one."""
    anchors = clustered if source is None else clustered.where(F.col("source") == source)
    target = links.join(anchors.select(F.col("ord").alias("anchor"), F.col("comp").alias("to")), "anchor").select(F.col("unit").alias("comp"), "to").dropDuplicates(["comp"])
    low = target.groupBy("to").agg(F.min("comp").alias("low")).select("to", F.least("to", "low").alias("root"))
    moves = target.join(by_shuffle(low), "to").select("comp", "root").unionByName(low.select(F.col("to").alias("comp"), "root"))
    return clustered.join(by_shuffle(moves), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")


def link_settlements(clustered: DataFrame, settings: Settings = Settings(), subsets: bool = True) -> tuple[DataFrame, DataFrame]:
    """JN5 to JN9: (links (anchor, unit, rule, conf), ambiguous (anchor, unit, rule))."""
    table = cut(sale_units(clustered), "units")
    anchors = cut(_anchored(clustered.where("source = 'settlement'"), table.where("not sold"), settlement_target()), "anchors")
    free = table.where("sold").select(F.col("comp").alias("unit"), F.col("ord").alias("uord"), "currency", "gross", "base_gross", "events", "pay_dates", "dates")
    sales = one_of_alike(free.select("unit", "currency", "pay_dates", F.col("gross").alias("value")), ["currency", "pay_dates", "value"])
    near = _near(anchors.select("anchor", "currency", "value_date", "target"), sales.withColumn("day", F.explode("pay_dates")), settings.lag_days, settings.slack)
    direct = cut(unique_links(near.select("anchor", "unit", (F.col("value") == F.col("target")).alias("exact"), "crowd")), "links")
    links = direct.select("anchor", "unit", F.lit("payment-to-settlement@v1").alias("rule"), F.lit(0.98).alias("conf"))
    ambiguous = None
    rest = anchors.join(direct, "anchor", "left_anti")
    free = free.join(direct.select("unit"), "unit", "left_anti")
    if subsets:
        rest = cut(rest.withColumn("start", F.date_sub("value_date", settings.lag_days + 1)), "rest")
        seen = cut(_seen(free, "pay_dates", settings.lag_days, gross_as_of), "seen")
        singles = cut(_singles(rest, seen), "singles")
        many = _ambiguous_singles(singles, seen, settings).select("anchor", "unit", F.lit("ambiguous-single@v1").alias("rule"))
        found = cut(_subsets(rest.join(singles, "anchor", "left_anti"), seen, settings.split_size, settings), "subsets")
        links = links.unionByName(found.where("decided").select("anchor", "unit", F.lit("split-settlement@v1").alias("rule"), F.lit(0.92).alias("conf")))
        ambiguous = many.unionByName(found.where("not decided").select("anchor", "unit", F.lit("ambiguous-split@v1").alias("rule")))
        rest = rest.join(found.where("decided").select("anchor").distinct(), "anchor", "left_anti")
        free = free.join(found.where("decided").select("unit"), "unit", "left_anti")
    late = unique_links(late_candidates(rest, free, settings), repeat=False)
    links = links.unionByName(late.select("anchor", "unit", F.lit("late-payout@v1").alias("rule"), F.lit(0.9).alias("conf")))
    return links, ambiguous


def _as_of_rows(free: DataFrame) -> DataFrame:
    """Validity rows of each unit's gross: from each deduction date until the next."""
    starts = F.array_sort(F.array_distinct(F.concat(F.array(F.lit("0001-01-01").cast("date")), F.transform("events", lambda e: e.value_date))))
    rows = free.withColumn("starts", starts).select("*", F.posexplode("starts").alias("i", "valid_from"))
    rows = rows.withColumn("valid_to", F.get("starts", F.col("i") + 1))
    return rows.withColumn("value", gross_as_of(F.col("valid_from"))).drop("starts", "i")


def late_candidates(anchors: DataFrame, free: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """JN9: as-of join of payouts to units paid up to ``max_payout_lag_days`` before, exact amounts only."""
    # days in stretches of the longest lag: a sale lies in the payout's stretch or the one before it
    stretch = lambda d: F.floor(F.datediff(d, F.lit("1970-01-01").cast("date")) / settings.max_payout_lag_days)
    sales = free.select("unit", "currency", "base_gross", F.array_sort("events").alias("events"), F.array_max("pay_dates").alias("last_pay"))
    rows = _as_of_rows(one_of_alike(sales, ["currency", "base_gross", "events", "last_pay"])).withColumnRenamed("value", "target")
    rows = rows.withColumn("stretch", stretch(F.col("last_pay")))
    sought = anchors.select("anchor", "currency", "target", "value_date", F.explode(F.array(stretch(F.col("value_date")), stretch(F.col("value_date")) - 1)).alias("stretch"))
    pairs = sought.join(by_shuffle(rows), ["currency", "target", "stretch"]).where("value_date >= valid_from and (valid_to is null or value_date < valid_to)")
    pairs = pairs.where((F.col("last_pay") <= F.col("value_date")) & (F.datediff("value_date", "last_pay") <= settings.max_payout_lag_days))
    return pairs.select("anchor", "unit", F.lit(True).alias("exact"), "crowd").distinct()


def link_banks(clustered: DataFrame, settings: Settings = Settings(), subsets: bool = True) -> DataFrame:
    """JN10, JN11: (anchor, unit, rule, conf) of positive bank credits and the payouts behind them."""
    table = cut(payout_units(clustered), "units")
    anchors = cut(_anchored(clustered.where("source = 'bank' and amount > 0"), table.where("not paid"), F.col("amount")), "anchors")
    free = table.where("paid").select(F.col("comp").alias("unit"), F.col("ord").alias("uord"), "currency", F.col("net").alias("value"), F.array_sort("refs").alias("refs"), "setl_dates", "dates")
    # an anchor lacks a payout and a unit has one, so no unit is an anchor's own component
    payouts = one_of_alike(free.select("unit", "currency", "value", "setl_dates", "refs"), ["currency", "value", "setl_dates", "refs"])
    near = _near(anchors.select("anchor", "currency", "value_date", "target", "reference"), payouts.withColumn("day", F.explode("setl_dates")), 0, 0)
    near = near.where(~references_contradict(F.col("refs"), F.col("reference")))
    direct = cut(unique_links(near.select("anchor", "unit", F.lit(True).alias("exact"), "crowd")), "links")
    links = direct.select("anchor", "unit", F.lit("bank-to-settlement@v1").alias("rule"), F.lit(0.96).alias("conf"))
    if not subsets:
        return links
    rest = anchors.join(direct, "anchor", "left_anti").withColumn("start", F.date_sub("value_date", 1))
    free = free.join(direct.select("unit"), "unit", "left_anti")
    seen = cut(_seen(free, "setl_dates", 0, lambda _: F.col("value")), "seen")
    found = _subsets(rest.join(_singles(rest, seen), "anchor", "left_anti"), seen, settings.merge_size, settings)
    return links.unionByName(found.where("decided").select("anchor", "unit", F.lit("merged-bank-credit@v1").alias("rule"), F.lit(0.9).alias("conf")))

