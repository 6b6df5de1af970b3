"""From files to entries: readers, the one door that every export goes through, and normalising."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tieout.functions.scalars import clean_ref, currency_code, dispute_state, mine_reference, parse_date, parse_minor
from tieout.schema import ENTRY, SOURCES, as_entries
from tieout.sources import mapping, quality

# File names by source, and what ids of unnamed rows start with.
FILES = {"payment": "payments", "settlement": "settlements", "bank": "bank", "ledger": "ledger", "refund": "refunds", "chargeback": "chargebacks"}
PREFIX = {"payment": "pay", "settlement": "setl", "bank": "bank", "ledger": "ldgr"}
#: Distance between the order numbers of two sources.
SPAN = 10**13


def read(spark: SparkSession, path: str) -> DataFrame:
    """SC1, SC2: text columns of a CSV file, of JSON lines, or of a JSON array or object with ``items`` or ``rows``; any path that Spark reads.

    ``_corrupt`` marks rows that aren't records, and CSV rows with other than the heading's fields. A byte
    order mark is skipped, bytes that aren't UTF-8 are replaced.
    """
    if path.endswith(".csv"):
        rows = spark.read.option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", quality.CORRUPT)
        names = rows.csv(path).columns
        return rows.schema(", ".join(f"`{n.replace('`', '``')}` string" for n in (*names, quality.CORRUPT))).csv(path)
    if path.endswith(".jsonl"):
        return json_records(spark.read.text(path).where("trim(value) <> ''").select(F.try_parse_json(F.regexp_replace("value", "^\ufeff", "")).alias("record")))
    from tieout.sources.gateway import records

    return json_records(records(spark.read.text(path, wholetext=True)))


def json_records(found: DataFrame) -> DataFrame:
    """Text columns of records (record variant), one a key that any of them has, and ``_corrupt`` for what is no object."""
    rows = found.select(F.try_variant_get("record", "$", "map<string,string>").alias("r"))
    keys = [k for k, in rows.select(F.explode(F.map_keys("r"))).distinct().orderBy("col").collect()]  # headings, not data
    return rows.select(*[F.col("r")[k].alias(k) for k in keys], F.when(F.col("r").isNull(), F.lit(quality.NO_RECORD)).alias(quality.CORRUPT))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """SC6: (grp, id) of a JSON object that maps groups to lists of ids."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("grp", "ids")).select("grp", F.explode("ids").alias("id"))


def categories(spark: SparkSession, path: str) -> DataFrame:
    """SC6: (id, category) of a JSON object that maps ids to categories."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,string>")).alias("id", "category"))


def existing(spark: SparkSession, folder: str) -> dict[str, str]:
    """SC3, SC5: the file of each source that a folder holds, by Spark's own file systems."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    names = {s.getPath().getName() for s in root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(root)}
    return {s: f"{folder.rstrip('/')}/{stem}{ext}" for s, stem in FILES.items() for ext in (".jsonl", ".json", ".csv") if f"{stem}{ext}" in names}


def numbered(rows: DataFrame, order: str = "_row") -> DataFrame:
    """``rows`` with ``n`` from 0 in the order of a monotonically increasing id: counts of its partitions, then numbers within each."""
    part = F.shiftright(order, 33)
    counts = rows.groupBy(part.alias("_part")).count()
    before = counts.select("_part", (F.sum("count").over(Window.orderBy("_part")) - F.col("count")).alias("_before"))  # one row a partition
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return rows.withColumn("_part", part).withColumn("_inside", inside).join(F.broadcast(before), "_part").withColumn("n", F.col("_before") + F.col("_inside")).drop("_part", "_inside", "_before")


def prepare(df: DataFrame, source: str) -> DataFrame:
    """MP11: mapped and checked rows; a file whose columns can't be told raises MappingError."""
    found = mapping.detect([c for c in df.columns if c != quality.CORRUPT], source)
    if not found.usable:
        raise mapping.MappingError(f"{source}: " + "; ".join(found.explain()))
    return quality.assess(mapping.apply(df, found), source)


def preview(df: DataFrame, source: str, rows: int = 500, samples: int = 3) -> tuple[mapping.Mapping, DataFrame | None, DataFrame | None]:
    """MP12: the mapping and, where it is usable, the quality of the first rows and some of them as they would be read."""
    found = mapping.detect([c for c in df.columns if c != quality.CORRUPT], source)
    if not found.usable:
        return found, None, None
    assessed = quality.assess(mapping.apply(df.limit(rows), found), source)
    return found, quality.summary(assessed), assessed.where("accepted").drop("raw", "_row", "issues", "empty", "accepted", quality.CORRUPT).limit(samples)


def normalize(accepted: DataFrame, source: str) -> DataFrame:
    """FN5, FN7: entries of accepted rows, with ``ord`` in file order after all earlier sources."""
    rows = numbered(accepted)
    prefix = PREFIX.get(source, source)
    own = F.coalesce(clean_ref(F.col("id")), F.concat(F.lit(f"{prefix}_"), F.col("n").cast("string")))
    amount, fee = quality.minor_amount(), lambda c: F.coalesce(parse_minor(F.col(c)), F.lit(0).cast("long"))
    reference, related, narration = clean_ref(F.col("reference"), own), F.lit(None).cast("string"), F.coalesce("narration", "status")
    method = F.lit(None).cast("string")
    if source == "payment":
        method, narration = F.col("method"), F.coalesce("method", "narration", "status")
    elif source == "settlement":
        narration = F.lit("payout")
    elif source == "bank":
        amount = F.when(F.lower(F.trim("type")).isin("debit", "dr", "d") & (amount > 0), -amount).otherwise(amount)
    if source in ("bank", "ledger"):
        narration = F.col("narration")
        reference = F.coalesce(clean_ref(F.col("reference")), mine_reference(F.col("narration")))
    if source in ("refund", "chargeback"):
        amount, reference, related = F.abs(amount), own, clean_ref(F.col("payment_id"), F.col("reference"))
    tds = F.when(F.coalesce(F.trim("tds"), F.lit("")) != "", parse_minor(F.col("tds")))
    return as_entries(rows.select(
        own.alias("id"), F.lit(source).alias("source"), amount.alias("amount"), parse_date(F.col("date")).alias("value_date"), currency_code(F.coalesce("currency", F.lit(""))).alias("currency"),
        reference.alias("reference"), narration.alias("narration"), method.alias("method"), related.alias("related"), fee("fees").alias("fee"), fee("tax").alias("tax"), tds.alias("tds"),
        (F.coalesce(F.trim("fees"), F.lit("")) != "").alias("fee_reported"), F.when(F.lit(source == "chargeback"), dispute_state(F.col("status"))).alias("dispute"),
        (F.lit(SOURCES.index(source) * SPAN) + F.col("n")).alias("ord"),
    ))


def disambiguate(entries: DataFrame) -> DataFrame:
    """FN32: the nth row of one id gets ``#n``."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    return entries.withColumn("_nth", nth).withColumn("id", F.when(F.col("_nth") > 1, F.concat("id", F.lit("#"), F.col("_nth").cast("string"))).otherwise(F.col("id"))).drop("_nth")


def entries_of(tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(entries of all sources, assessed rows with ``source``) from raw exports by source."""
    unknown = set(tables) - set(SOURCES)
    if unknown:
        raise ValueError(f"unknown sources: {sorted(unknown)}")
    if not tables:
        raise ValueError("no exports")
    return joined({s: prepare(tables[s], s) for s in SOURCES if s in tables})


def joined(assessed: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(entries of the accepted rows, all rows with ``source``) of assessed rows by source."""
    parts = [normalize(a.where("accepted"), s) for s, a in assessed.items()]
    every = [a.withColumn("source", F.lit(s)) for s, a in assessed.items()]
    return disambiguate(reduce(DataFrame.unionByName, parts)), reduce(DataFrame.unionByName, every)


def guard(tables: dict[str, DataFrame], max_rows: int) -> dict[str, DataFrame]:
    """SC7: ``tables`` again, or a ValueError if they hold more than ``max_rows`` rows together; asked before any mapping.

    Only as many rows as the limit allows are counted.
    """
    if tables:
        found = reduce(DataFrame.unionAll, [t.select(F.lit(1)) for t in tables.values()]).limit(max_rows + 1).count()
        if found > max_rows:
            raise ValueError(f"more than {max_rows} rows")
    return tables


def datasets(spark: SparkSession, root: str) -> list[str]:
    """SC5: names of the folders below ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()) if fs.exists(path) else []


def load_dataset(spark: SparkSession, root: str, name: str) -> tuple[dict[str, DataFrame], DataFrame | None, DataFrame | None]:
    """SC4: (exports by source, labels (grp, id), truth (id, category)) of a named folder; absent files give None, names are never paths."""
    if not isinstance(name, str) or not name.isascii() or not 0 < len(name) <= 64 or not name.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"invalid dataset name {name!r}")
    if name not in datasets(spark, root):
        raise FileNotFoundError(f"no dataset {name!r} in {root}")
    folder = f"{root.rstrip('/')}/{name}"
    root_path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    names = {s.getPath().getName() for s in root_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(root_path)}
    truth = categories(spark, f"{folder}/truth.json") if "truth.json" in names else None
    held = labels(spark, f"{folder}/labels.json") if "labels.json" in names else None
    return {s: read(spark, p) for s, p in existing(spark, folder).items()}, held, truth


def with_provenance(entries: DataFrame, origin: str) -> DataFrame:
    """SC10: ``entries`` with where they came from."""
    return entries.withColumn("provenance", F.lit(origin))


def read_folder(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """SC3: entries and assessed rows of the exports in a folder."""
    return entries_of({s: read(spark, p) for s, p in existing(spark, folder).items()})


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ENTRY)
