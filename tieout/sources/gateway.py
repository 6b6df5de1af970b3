"""Rows as a payment gateway's API answers them: pages of records of uneven shape, kept as VARIANT until fields are taken."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions.scalars import parse_epoch
from tieout.sources import ingest, quality

#: Field of a mapped row -> places of it in a record, the first that is there counts.
FIELDS = {
    "payment": {"reference": ["order_id", "acquirer_data.rrn", "id"], "narration": ["description", "status"], "fees": ["fee"], "tax": ["tax"], "method": ["method"]},
    "refund": {"payment_id": ["payment_id"]},
    "settlement": {"reference": ["utr", "id"], "fees": ["fees"], "tax": ["tax"]},
}


def records(pages: DataFrame) -> DataFrame:
    """SC2: (record variant) of pages (value text): arrays of records, or objects that hold one in ``items`` or ``rows``."""
    page = F.parse_json(F.regexp_replace("value", "^﻿", ""))
    held = [F.try_variant_get(page, path, "array<variant>") for path in ("$.items", "$.rows", "$")]
    return pages.select(F.explode(F.coalesce(*held)).alias("record"))


def _text(path: str) -> Column:
    return F.try_variant_get("record", f"$.{path}", "string")


def mapped(found: DataFrame, source: str) -> DataFrame:
    """SC9: records of a source as mapped rows: whole amounts are minor units, times are seconds since the epoch, payments count once captured.

    What isn't an object is kept, to be refused as no record.
    """
    if source not in FIELDS:
        raise ValueError(f"the gateway has no {source} records")
    whole = F.try_variant_get("record", "$", "map<string,variant>").isNotNull()
    if source == "payment":
        found = found.where(~whole | F.coalesce(F.try_variant_get("record", "$.captured", "boolean"), F.lower(_text("status")) == "captured", F.lit(False)))
    of = lambda field: F.coalesce(*map(_text, paths)) if (paths := FIELDS[source].get(field)) else F.lit(None).cast("string")
    epoch = F.try_variant_get("record", "$.created_at", "bigint")
    date = F.when(epoch.isNotNull(), F.date_format(parse_epoch(epoch), "yyyy-MM-dd")).otherwise(_text("created_at"))
    columns = [c.alias(n) for n, c in (("id", _text("id")), ("amount", _text("amount")), ("date", date), ("currency", _text("currency")), ("status", _text("status")))]
    columns += [of(f).alias(f) for f in ("reference", "narration", "fees", "tax", "tds", "method", "payment_id", "type")]
    return found.select(*columns, F.lit(None).cast("double").alias("amount_major"), F.to_json("record").alias("raw"), F.when(~whole, F.lit(quality.NO_RECORD)).alias(quality.CORRUPT), F.monotonically_increasing_id().alias("_row"))


def entries_of(pages: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(entries, assessed rows with ``source``) of the gateway's pages by source; entries say that they came from it."""
    entries, assessed = ingest.joined({s: quality.assess(mapped(records(p), s), s) for s, p in pages.items()})
    return ingest.with_provenance(entries, "gateway"), assessed


def read(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """:func:`entries_of` of files, each a page."""
    return entries_of({s: spark.read.text(p, wholetext=True) for s, p in paths.items()})
