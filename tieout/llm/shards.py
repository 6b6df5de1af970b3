"""Sharding by balanced label propagation.

Documents that share a link key (here: equal texts) are neighbours. Each starts in a shard by hash;
in every round each linked document votes for the shard where most of its neighbours are, of ties the
lowest, among shards with room, and moves are let through up to that room. Votes are one row of counts
a key, so a key that a third of all rows share costs one combined sum and one join dealt over parts
of that key. At the end rows
move, unlinked ones first, until shards differ by one row at most (law ``rows``), and each row gets a
gapless slot in its shard from counts of small cells, without a task that holds a shard.

What reaches the driver are counts by pairs of shards.

Defined cases: null text has size 8 and CRC 0 and links with other null texts; null and repeated
doc_ids keep a row each; fewer rows than shards leaves shards empty; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, for_each_salt, hot_parts, salted

SHARDS = 24
ROUNDS = 16
#: Rows of a cell in which slots are counted.
CELL = 5_000


def _start(shards: int) -> Column:
    return F.pmod(F.xxhash64("rid", F.lit(11)), F.lit(shards)).cast("int")


def propagate(links: DataFrame, rows: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(rid, shard) of linked rows; links: (rid, key), rows sharing a key are neighbours; rows: of all, linked or not."""
    cap = max(1, rows // shards)
    links = links.where("key is not null").distinct()
    shared = cut(links.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "keys")
    hot = cut(hot_parts(shared, rows), "hot")
    links = cut(salted(links, hot, "key", ["rid"]).join(for_each_salt(shared.select("key"), hot, "key"), ["key", "salt"]), "links")
    discard(shared)
    state = cut(links.select("rid").distinct().select("rid", _start(shards).alias("shard")), "labels")
    for round_ in range(rounds):
        held = {s: n for s, n in state.groupBy("shard").count().collect()}  # a row a shard
        room = [max(0, cap - held.get(s, 0)) for s in range(shards)]
        ballots = links.join(state, "rid").groupBy("key").agg(F.array(*[F.count_if(F.col("shard") == s) for s in range(shards)]).alias("v"))
        votes = links.join(for_each_salt(ballots, hot, "key"), ["key", "salt"]).groupBy("rid").agg(F.array(*[F.sum(F.col("v")[s]) for s in range(shards)]).alias("v"))
        open_ = F.array(*[F.lit(r > 0) for r in room])
        choice = F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.get("v", s).alias("n"), (-s).alias("s"))),
            lambda c: (-c.s == F.col("shard")) | F.get(open_, -c.s),
        )
        wish = state.join(votes, "rid").select("rid", "shard", (-F.array_max(choice)["s"]).alias("to"))
        wish = cut(wish, "wishes")
        asked = dict.fromkeys(range(shards), 0)
        for to, n in wish.where("to <> shard").groupBy("to").count().collect():  # a row a shard
            asked[to] = n
        if not sum(asked.values()):
            discard(wish)
            break
        share = F.array(*[F.lit(min(1.0, room[s] / asked[s]) if asked[s] else 0.0) for s in range(shards)])
        lot = F.pmod(F.xxhash64("rid", F.lit(round_)), F.lit(1 << 20)) / float(1 << 20)
        new = cut(wish.select("rid", F.when(lot < F.get(share, F.col("to")), F.col("to")).otherwise(F.col("shard")).alias("shard")), "labels")
        discard(wish)
        discard(state)
        state = new
    discard(links)
    discard(hot)
    return state


def _ranked(rows: DataFrame, by: list[str], cells: int, name: str) -> DataFrame:
    """``rows`` with a gapless number from 0 within each value of by[0], ordered by the rest of ``by``, then by cell.

    Cells are counted, their counts summed up, and only a cell's rows are sorted together.
    """
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("rid", F.lit(5)), F.lit(cells)).cast("int"))
    counts = rows.groupBy(*by, "cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(by[0]).orderBy(*by[1:], "cell")) - F.col("n")
    offsets = counts.select(*by, "cell", before.alias("before"))
    inside = F.row_number().over(Window.partitionBy(*by, "cell").orderBy("rid")) - 1
    return rows.withColumn("inside", inside).join(offsets, [*by, "cell"]).withColumn(name, F.col("before") + F.col("inside")).drop("cell", "inside", "before")


def balance(rows: DataFrame, shards: int, total: int) -> DataFrame:
    """Move rows (rid, linked, shard) so that shards differ by one row at most, unlinked rows first."""
    held = dict(rows.groupBy("shard").count().collect())  # a row a shard
    held = [held.get(s, 0) for s in range(shards)]
    largest = sorted(range(shards), key=lambda s: (-held[s], s))[: total % shards]
    goal = [total // shards + (s in largest) for s in range(shards)]
    over = [max(0, h - g) for h, g in zip(held, goal)]
    ends = list(accumulate(max(0, g - h) for h, g in zip(held, goal)))
    if not sum(over):
        return rows.select("rid", "shard")
    ranked = _ranked(rows, ["shard", "linked"], max(1, total // shards // CELL), "place")
    starts = [0, *accumulate(over)]
    lits = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    number = F.get(lits(starts), F.col("shard")) + F.col("place")  # of the row among all that move
    to = F.size(F.filter(lits(ends), lambda e: e <= number))
    return ranked.select("rid", F.when(F.col("place") < F.get(lits(over), F.col("shard")), to).otherwise(F.col("shard")).cast("int").alias("shard"))


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot: all documents, equal texts kept together as far as quotas let them."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = cut(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.lit("")).otherwise(F.md5(text)).alias("key"), F.monotonically_increasing_id().alias("rid"),
    ), "rows")
    total = base.count()
    linked = propagate(base.select("rid", "key"), total, shards)
    rows = base.select("rid").join(linked, "rid", "left").select("rid", F.col("shard").isNotNull().cast("int").alias("linked"), F.coalesce("shard", _start(shards)).alias("shard"))
    placed = cut(balance(cut(rows, "placed"), shards, total), "placed")
    slots = _ranked(placed, ["shard"], max(1, total // shards // CELL), "slot")
    return base.join(slots, "rid").select("doc_id", "size", "text_crc32", "shard", "slot")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 whose row counts differ by one at most."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
