"""Row checks: what is wrong with each row of a mapped export, and what is kept."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.functions.scalars import ALIASES, MINOR_UNITS, NO_DATE, major_to_minor, parse_date, parse_minor
from tieout.sources.mapping import CORRUPT

IMPLAUSIBLE = 10**13
#: What ``_corrupt`` says of a row that is no record; other text there is that of a torn row.
NO_RECORD = "not a record"
CHECKED = ["id", "amount", "date", "reference", "narration", "currency", "payment_id"]


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c)), F.lit("")) == ""


def _issue(when: Column, name: str, problem: str | Column, severity: str) -> Column:
    said = F.lit(problem) if isinstance(problem, str) else problem
    return F.when(when, F.struct(F.lit(name).alias("field"), said.alias("problem"), F.lit(severity).alias("severity")))


def minor_amount() -> Column:
    """Minor units of a mapped row, from text or from a folded debit and credit."""
    return F.when(F.col("amount_major").isNotNull(), major_to_minor(F.col("amount_major"))).otherwise(parse_minor(F.col("amount")))


def assess(rows: DataFrame, source: str) -> DataFrame:
    """QV1 to QV8: ``rows`` with ``issues``, ``empty`` and ``accepted``.

    A row with an id may only repeat an id, one with a reference alone only a whole row, so one window serves
    both. Others get a key of their own, so that blanks don't meet in one task. What a row says by itself is
    checked before rows are shuffled: where only ``accepted`` is asked for, its texts stay behind.
    """
    corrupt = F.col(CORRUPT) if CORRUPT in rows.columns else F.lit(None).cast("string")
    no_record = F.coalesce(corrupt == NO_RECORD, F.lit(False))
    empty = reduce(lambda a, b: a & b, [_blank(c) for c in CHECKED]) & F.col("amount_major").isNull() & ~no_record
    own = F.concat(F.lit("\0"), F.col("_row").cast("string"))
    unnamed = _blank("id") & ~_blank("reference")
    signature = F.to_json(F.struct(F.coalesce("amount", F.col("amount_major").cast("string"), F.lit("")).alias("a"), F.coalesce("date", F.lit("")).alias("d"), F.lower(F.trim("reference")).alias("r")))
    key = F.when(~_blank("id"), F.concat(F.lit("i"), F.trim("id"))).when(unnamed, F.concat(F.lit("r"), signature)).otherwise(own)
    alike = Window.partitionBy("_key").orderBy("_row")
    minor, folded = minor_amount(), F.col("amount_major").isNotNull()
    no_amount = ~folded & _blank("amount")
    zero_text = F.trim("amount").isin("0", "0.0", "0.00")
    code = F.upper(F.trim("currency"))
    bad_amount, huge = ~no_amount & ~folded & (minor == 0) & ~zero_text, F.abs(minor) > IMPLAUSIBLE
    bad_date = ~_blank("date") & (parse_date(F.col("date")) == F.lit(NO_DATE).cast("date"))
    wrong = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in (no_record, no_amount, bad_amount, huge, _blank("date"), bad_date)])
    marked = rows.withColumns({"_key": key, "empty": empty, "_fine": ~empty & ~wrong, "_named": ~_blank("id")})
    marked = marked.withColumns({"_nth": F.row_number().over(alike), "_first": F.first("_row").over(alike)})
    repeats = F.col("_named") & (F.col("_nth") > 1)
    issues = F.array_compact(F.array(
        _issue(corrupt.isNotNull(), "row", "torn: not as many fields as headings", "warning"),
        _issue(no_amount, "amount", "missing", "error"),
        _issue(bad_amount, "amount", "not a number", "error"),
        _issue(huge, "amount", "implausibly large", "error"),
        _issue((minor < 0) & F.lit(source in ("payment", "settlement", "refund", "chargeback")), "amount", "negative", "warning"),
        _issue(_blank("date"), "date", "missing", "error"),
        _issue(bad_date, "date", "not a date", "error"),
        _issue(~_blank("currency") & ~code.isin(list(MINOR_UNITS)) & ~code.isin(list(ALIASES)), "currency", "unknown, taken as INR", "warning"),
        _issue(repeats, "id", F.concat(F.lit("repeats row "), F.col("_first").cast("string")), "error"),
        _issue(unnamed & (F.col("_nth") > 1), "reference", "exported twice", "warning"),
        _issue(_blank("payment_id") & F.lit(source in ("refund", "chargeback")), "payment_id", "names no payment", "warning"),
    ))
    issues = F.when(no_record, F.array(_issue(F.lit(True), "row", NO_RECORD, "error"))).otherwise(issues)
    marked = marked.withColumn("issues", F.when(F.col("empty"), F.array().cast("array<struct<field:string,problem:string,severity:string>>")).otherwise(issues))
    return marked.withColumn("accepted", F.col("_fine") & ~repeats).drop("_key", "_fine", "_named", "_nth", "_first")


def summary(assessed: DataFrame) -> DataFrame:
    """QV9: one row: rows, accepted, quarantined, empty, duplicates, accepted share (1 if none)."""
    n = F.count_if(~F.col("empty"))
    return assessed.agg(
        n.alias("rows"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted") & ~F.col("empty")).alias("quarantined"), F.count_if("empty").alias("empty"),
        F.count_if(F.exists("issues", lambda i: i.problem == "exported twice")).alias("exported_twice"), F.when(n > 0, F.bround(F.count_if("accepted") / n, 4)).otherwise(1.0).alias("accepted_share"),
    )


def problems(assessed: DataFrame) -> DataFrame:
    """QV9: how often each problem was met, rows that a problem names left out of its text."""
    said = F.regexp_replace("i.problem", r"row \d+", "a row")
    return assessed.select(F.explode("issues").alias("i")).groupBy("i.field", said.alias("problem"), "i.severity").agg(F.count("*").alias("n"))


def samples(assessed: DataFrame, limit: int = 25) -> DataFrame:
    """SL6: the first issues."""
    return assessed.select("_row", F.explode("issues").alias("i")).select("_row", "i.*").orderBy("_row", "field").limit(limit)


def rollup(assessed: DataFrame) -> DataFrame:
    """QV10: counts by source and over all (source null)."""
    return assessed.rollup("source").agg(F.count_if(~F.col("empty")).alias("rows"), F.count_if("accepted").alias("accepted"), F.count_if("empty").alias("empty"))
