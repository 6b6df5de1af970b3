"""Where a run's results go: Spark's own writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.functions.scalars import minor_units
from tieout.plans.engine import Result
from tieout.sources.ingest import numbered
from tieout.tables import cut


def exceptions_csv(exceptions: DataFrame, path: str) -> None:
    """SK4: seven columns, amounts in major units."""
    out = exceptions.select("id", "source", "category", (F.col("amount") / 100).alias("amount"), "value_date", F.col("conf").alias("confidence"), F.replace(F.col("action"), F.lit(","), F.lit(";")).alias("action"))
    out.write.option("header", True).option("emptyValue", "").csv(path)


#: Columns of the worklist's export.
EXPORTED = ["fingerprint", "entry_id", "source", "category", "amount", "currency", "value_date", "priority", "status", "times_seen", "assignee", "rationale"]


def worklist_csv(items: DataFrame, path: str) -> None:
    """SK7: items, such as a page, as spreadsheets like them: a byte order mark, every field quoted, lines ended by CR LF, amounts in major units."""
    amount = F.format_string("%.2f", F.col("amount") / F.coalesce(minor_units(F.col("currency")), F.lit(100)))
    fields = [F.coalesce(amount if c == "amount" else F.col(c).cast("string"), F.lit("")) for c in EXPORTED]
    quoted = [F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')) for c in fields]
    rows = items.select(F.lit(1).alias("n"), F.monotonically_increasing_id().alias("at"), F.concat_ws(",", *quoted).alias("value"))
    head = items.sparkSession.range(1).select(F.lit(0).alias("n"), F.col("id").alias("at"), F.lit("\ufeff" + ",".join(f'"{c}"' for c in EXPORTED)).alias("value"))
    head.unionByName(rows).orderBy("n", "at").select("value").write.option("lineSep", "\r\n").text(path)


def entries_csv(entries: DataFrame, path: str) -> None:
    """SK5: entries by source, amounts as major units with two decimals."""
    text = entries.withColumn("amount", F.format_string("%.2f", F.col("amount") / 100))
    text.write.partitionBy("source").option("header", True).csv(path)


def write_result(result: Result, path: str) -> None:
    """SK1 to SK4: groups, exceptions, money, metrics and audit of a run below ``path``."""
    result.groups.write.json(f"{path}/groups")
    result.exceptions.write.json(f"{path}/exceptions")
    result.money().write.json(f"{path}/money")
    result.metrics().write.json(f"{path}/metrics")
    audit(result).write.json(f"{path}/audit")
    exceptions_csv(result.exceptions, f"{path}/exceptions_csv")


def audit(result: Result) -> DataFrame:
    """SK3, WN8: one row a decision, ``seq`` from 1: refusals, what was grouped and by which rules, what was raised."""
    g = result.groups.select(F.col("first_ord").alias("ord"), "stage", F.array_join("rules", "+").alias("rule"), F.col("entry_ids").alias("inputs"), F.lit("matched").alias("outcome"), "confidence", F.concat(F.array_join("sources", "+"), F.lit(": "), "status").alias("rationale"))
    rule = F.when(F.col("category") == "duplicate", "duplicate-in-group@v1").otherwise("classify-residual@v1")
    e = result.exceptions.select("ord", F.lit("structural").alias("stage"), rule.alias("rule"), F.array("id").alias("inputs"), F.lit("exception").alias("outcome"), F.col("conf").alias("confidence"), "rationale")
    rows = result.refused.unionByName(g).unionByName(e).withColumn("confidence", F.bround("confidence", 4))
    # a written table keeps its rows' order numbers from one read to the next
    rows = cut(rows, "audit").withColumn("_row", F.monotonically_increasing_id())
    return numbered(rows).select((F.col("n") + 1).alias("seq"), F.current_timestamp().alias("ts"), "stage", "rule", "inputs", "outcome", "confidence", "rationale")
