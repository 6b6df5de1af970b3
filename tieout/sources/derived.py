"""A reconciliation batch derived from an orders table, for queries that graded SQL can follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions.scalars import divide_half_away
from tieout.schema import SOURCES, as_entries


def base_of(orders: DataFrame) -> DataFrame:
    """One row an order: k, g (minor units), d, cur, bps, st, rf (refunded), fee, tax, net."""
    k, g = F.col("k"), F.col("g")
    b = orders.select(
        F.col("o_orderkey").alias("k"), F.round(F.col("o_totalprice") * 100).cast("long").alias("g"), F.to_date("o_orderdate").alias("d"),
        F.when(F.col("o_custkey") % 7 == 0, "USD").otherwise("INR").alias("cur"),
        F.when(F.col("o_orderpriority") == "2-HIGH", 0).when(F.col("o_orderpriority") == "3-MEDIUM", 180).when(F.col("o_orderpriority") == "1-URGENT", 300).otherwise(200).alias("bps"),
        F.col("o_orderstatus").alias("st"),
    )
    b = b.withColumn("rf", F.when(k % 19 == 0, F.call_function("div", 3 * g, F.lit(10))).otherwise(0).cast("long"))
    b = b.withColumn("fee", divide_half_away((g - F.col("rf")) * F.col("bps"), 10_000))
    b = b.withColumn("tax", divide_half_away(F.col("fee") * 1800, 10_000))
    return b.withColumn("net", g - F.col("rf") - F.col("fee") - F.col("tax"))


def batch_of(orders: DataFrame) -> DataFrame:
    """Entries of the batch: each order's legs from one scan, exploded; ``ord`` orders them by source, then order."""
    k, d, key = F.col("k"), F.col("d"), F.col("k").cast("string")

    def leg(source, when, id_, amount, date, reference, related=None, fee=None, tax=None):
        none = F.lit(None)
        return F.when(when, F.struct(
            F.lit(source).alias("source"), id_.alias("id"), amount.cast("long").alias("amount"), date.alias("value_date"),
            (none.cast("string") if reference is None else reference).alias("reference"), (none.cast("string") if related is None else related).alias("related"),
            (F.lit(0) if fee is None else fee).cast("long").alias("fee"), (F.lit(0) if tax is None else tax).cast("long").alias("tax"),
            (F.lit(SOURCES.index(source)) * F.lit(10**13) + k).alias("ord"),
        ))

    order, payout = F.concat(F.lit("ORD"), key), F.concat(F.lit("UTR"), key)
    refund = F.concat(F.lit("rf_"), key)
    legs = F.array(
        leg("payment", F.lit(True), F.concat(F.lit("pay_"), key), F.col("g"), d, order),
        leg("settlement", F.col("st").isin("F", "P"), F.concat(F.lit("set_"), key), F.col("net"), F.date_add(d, 2), payout, fee=F.col("fee"), tax=F.col("tax")),
        leg("bank", F.col("st") == "F", F.concat(F.lit("bnk_"), key), F.col("net") - F.when(k % 17 == 0, 1180).otherwise(0), F.date_add(d, 2), F.when(k % 13 != 0, payout)),
        leg("ledger", k % 11 != 0, F.concat(F.lit("led_"), key), F.col("g"), d, order),
        leg("refund", k % 19 == 0, refund, F.col("rf"), F.date_add(d, 1), refund, related=F.concat(F.when(k % 57 == 0, "pay_x").otherwise("pay_"), key)),
    )
    # absent legs are dropped after the explosion: a function over the array would have Spark interpret all legs instead of compiling them
    rows = base_of(orders).select("cur", F.explode(legs).alias("e")).where("e is not null").select("e.*", F.col("cur").alias("currency"))
    return as_entries(rows.withColumn("fee_reported", F.col("source") == "settlement"))


def batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_of(spark.read.parquet(f"{sf_dir}/orders.parquet"))


#: The same batch for DuckDB, as common table expressions.
BATCH_SQL = """
base0 AS (
  SELECT o_orderkey k, CAST(ROUND(o_totalprice * 100) AS BIGINT) g, CAST(o_orderdate AS DATE) d,
    CASE WHEN o_custkey % 7 = 0 THEN 'USD' ELSE 'INR' END cur,
    CASE o_orderpriority WHEN '2-HIGH' THEN 0 WHEN '3-MEDIUM' THEN 180 WHEN '1-URGENT' THEN 300 ELSE 200 END bps, o_orderstatus st
  FROM orders),
base1 AS (SELECT *, CASE WHEN k % 19 = 0 THEN (3 * g) // 10 ELSE 0 END rf FROM base0),
base2 AS (SELECT *, (2 * (g - rf) * bps + 10000) // 20000 fee FROM base1),
base3 AS (SELECT *, (2 * fee * 1800 + 10000) // 20000 tax FROM base2),
base AS (SELECT *, g - rf - fee - tax net FROM base3),
entries AS (
  SELECT 'pay_' || k id, 'payment' source, g amount, d value_date, cur currency, 'ORD' || k reference, CAST(NULL AS VARCHAR) related, 0::BIGINT fee, 0::BIGINT tax, k ord FROM base
  UNION ALL SELECT 'set_' || k, 'settlement', net, CAST(d + INTERVAL 2 DAY AS DATE), cur, 'UTR' || k, NULL, fee, tax, 10000000000000 + k FROM base WHERE st IN ('F', 'P')
  UNION ALL SELECT 'bnk_' || k, 'bank', net - CASE WHEN k % 17 = 0 THEN 1180 ELSE 0 END, CAST(d + INTERVAL 2 DAY AS DATE), cur, CASE WHEN k % 13 <> 0 THEN 'UTR' || k END, NULL, 0, 0, 20000000000000 + k FROM base WHERE st = 'F'
  UNION ALL SELECT 'led_' || k, 'ledger', g, d, cur, 'ORD' || k, NULL, 0, 0, 30000000000000 + k FROM base WHERE k % 11 <> 0
  UNION ALL SELECT 'rf_' || k, 'refund', rf, CAST(d + INTERVAL 1 DAY AS DATE), cur, 'rf_' || k, (CASE WHEN k % 57 = 0 THEN 'pay_x' ELSE 'pay_' END) || k, 0, 0, 40000000000000 + k FROM base WHERE k % 19 = 0)
"""
