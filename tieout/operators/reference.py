"""Rules by reference: shared references, and deductions that name their payment."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieout.operators.graph import connected_components
from tieout.schema import DEDUCTIONS
from tieout.tables import by_shuffle, cut

#: Entries of one reference that one task may sort.
HOT = 1_000_000
#: Heaps of references that are counted first.
HEAPS = 1 << 16


def _key(c: str):
    return F.lower(F.trim(F.col(c)))


def _reference():
    return F.when(F.col("reference") != "", _key("reference"))


def hot_references(entries: DataFrame, rows: int = HOT) -> DataFrame | None:
    """(ref, currency) of more than ``rows`` entries, at most one in ``rows`` of all; None where it is plain that there are none."""
    if entries.limit(rows + 1).count() <= rows:
        return None
    held = entries.select(_reference().alias("ref"), "currency").where("ref is not null")
    # references dealt into few heaps: where no heap is too large, none of its references is, and no reference was shuffled
    heaps = held.groupBy(F.pmod(F.xxhash64("ref", "currency"), F.lit(HEAPS)).alias("heap")).count().where(F.col("count") > rows)
    if not heaps.limit(1).count():
        return None
    found = held.groupBy("ref", "currency").count().where(F.col("count") > rows)
    return cut(found.select("ref", "currency"), "hot")


def exact_reference(entries: DataFrame, tolerance: int = 100, hot: DataFrame | None = None) -> DataFrame:
    """JN1: ``entries`` with ``comp``, the first ``ord`` of its cluster, and ``prev_id``, the member before it.

    Entries of one reference and currency are ordered by amount; a step of more than ``tolerance``
    starts a new cluster. Both windows run on one shuffle by (reference, currency); references of
    ``hot`` go by ranges of amounts instead, so that one of them is many tasks.
    """
    rows = entries.withColumn("ref", _reference())
    held = rows.where("ref is not null")
    spread = None
    if hot is not None:
        spread = _clusters_by_range(held.join(hot, ["ref", "currency"], "left_semi"), tolerance)
        held = held.join(hot, ["ref", "currency"], "left_anti")
    columns = rows.columns
    w = Window.partitionBy("ref", "currency").orderBy("amount", "ord")
    gap = F.col("amount") - F.lag("amount").over(w)
    held = held.withColumn("_new", F.coalesce((gap > tolerance).cast("int"), F.lit(1))).withColumn("_id", F.lag("id").over(w))
    held = held.withColumn("_island", F.sum("_new").over(w))
    held = held.withColumn("comp", F.min("ord").over(Window.partitionBy("ref", "currency", "_island")))
    held = held.withColumn("prev_id", F.when(F.col("_new") == 0, F.col("_id"))).select(*columns, "comp", "prev_id")
    alone = rows.where("ref is null").withColumn("comp", F.col("ord")).withColumn("prev_id", F.lit(None).cast("string"))
    out = held.unionByName(alone)
    return out if spread is None else out.unionByName(spread.select(out.columns))


def _clusters_by_range(held: DataFrame, tolerance: int) -> DataFrame:
    """The same clusters from rows dealt out by ranges: each part looks back at the last row of the part before it, and counts on from its clusters."""
    order = ["ref", "currency", "amount", "ord"]
    parts = cut(held.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    row = F.struct("ref", "currency", "amount", "id")
    by_part = Window.orderBy("_part")  # a row a part
    ends = parts.groupBy("_part").agg(F.max_by(row, F.struct(*order)).alias("_end")).select("_part", F.lag("_end").over(by_part).alias("_end"))
    w = Window.partitionBy("_part").orderBy(*order)
    rows = parts.join(F.broadcast(ends), "_part").withColumn("_before", F.coalesce(F.lag(row).over(w), F.col("_end"))).drop("_end")
    before = F.col("_before")
    goes_on = (before["ref"] == F.col("ref")) & (before["currency"] == F.col("currency")) & (F.col("amount") - before["amount"] <= tolerance)
    rows = rows.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("long")).withColumn("prev_id", F.when(F.col("_new") == 0, before["id"])).drop("_before")
    counts = rows.groupBy("_part").agg(F.sum("_new").alias("_n")).select("_part", (F.sum("_n").over(by_part) - F.col("_n")).alias("_base"))
    rows = rows.join(F.broadcast(counts), "_part").withColumn("_island", F.col("_base") + F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    first = rows.groupBy("_island").agg(F.min("ord").alias("comp"))
    return rows.join(first, "_island")


def reference_edges(clustered: DataFrame) -> DataFrame:
    """Consecutive members of clusters, as the edges of the rule."""
    return clustered.where("prev_id is not null").select(F.col("prev_id").alias("a"), F.col("id").alias("b"), "ref", "currency")


def deduction_links(clustered: DataFrame) -> DataFrame:
    """JN2, JN3: deductions with the payment they name; ``same`` false where currencies differ.

    A payment answers to its reference and its id, the first payment to each handle. ``claimed`` runs
    over a payment's accepted deductions in entry order, ``left_over`` is what they leave of it.
    """
    pay = clustered.where("source = 'payment'")
    handle = F.explode(F.array(_key("reference"), _key("id"))).alias("handle")
    named = F.struct("ord", F.col("id").alias("payment_id"), F.col("amount").alias("payment_amount"), F.col("currency").alias("payment_currency"), F.col("comp").alias("payment_comp"))
    taken = clustered.where(F.col("source").isin(DEDUCTIONS)).withColumn("handle", _key("related")).where("handle <> ''")
    asked = taken.select("handle").distinct()
    handles = pay.select(handle, named.alias("p")).join(by_shuffle(asked), "handle", "left_semi").groupBy("handle").agg(F.min("p").alias("p"))
    found = taken.join(by_shuffle(handles), "handle").select("id", "source", "amount", "currency", "value_date", "ord", "comp", F.col("p.payment_id"), F.col("p.payment_amount"), F.col("p.payment_currency"), F.col("p.payment_comp"))
    found = found.withColumn("same", F.col("currency") == F.col("payment_currency"))
    w = Window.partitionBy("payment_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = found.withColumn("claimed", F.sum(F.when(F.col("same"), F.col("amount")).otherwise(0)).over(w))
    return found.withColumn("left_over", F.col("payment_amount") - F.col("claimed"))


def over_refunds(links: DataFrame) -> DataFrame:
    """JN4: payments whose accepted deductions exceed them."""
    total = links.where("same").groupBy("payment_id").agg(F.max("payment_amount").alias("payment_amount"), F.sum("amount").alias("deducted"))
    return total.where("deducted > payment_amount").withColumn("excess", F.col("deducted") - F.col("payment_amount"))


def merge_deductions(clustered: DataFrame, links: DataFrame) -> DataFrame:
    """``clustered`` with each linked deduction's cluster and its payment's as one ``comp``.

    Nearly always a deduction is a cluster of its own and joins one payment, which is a lookup. Only if
    some linked deduction shares its cluster are the linked clusters' components worked out.
    """
    pairs = links.where("same and comp <> payment_comp").select("comp", "payment_comp").distinct()
    linked = pairs.select("comp").distinct()
    crowded = clustered.join(by_shuffle(linked), "comp", "left_semi").groupBy("comp").count().where("count > 1").limit(1).count()
    if crowded:
        roots = connected_components(pairs).select(F.col("node").alias("comp"), "root")
    else:  # stars around payments
        roots = pairs.groupBy("payment_comp").agg(F.min("comp").alias("low"))
        low = roots.select("payment_comp", F.least("low", "payment_comp").alias("root"))
        roots = pairs.join(by_shuffle(low), "payment_comp").select("comp", "root").unionByName(low.select(F.col("payment_comp").alias("comp"), "root"))
    return clustered.join(by_shuffle(roots), "comp", "left").withColumn("comp", F.coalesce("root", "comp")).drop("root")


def references_contradict(refs, reference):
    """PR3: both sides name references and none agree."""
    return (F.size(refs) > 0) & (F.coalesce(reference, F.lit("")) != "") & ~F.array_contains(refs, F.lower(F.trim(reference)))


