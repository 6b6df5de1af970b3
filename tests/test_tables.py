"""Tables that the engine writes and reads back, as sides of joins."""

from pyspark.sql import functions as F

from tieout import tables


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_tables_are_not_broadcast(spark):
    """Compressed, the table is small enough for Spark to broadcast it whatever its rows take."""
    rows = spark.range(300_000)
    held = tables.cut(rows.select("id", F.xxhash64("id").alias("n")), "held")
    few = tables.cut(spark.range(10), "few")
    other = tables.cut(rows, "other")
    for how in ("inner", "left_semi", "left_anti"):
        assert "Broadcast" not in _plan(other.join(held.where("n > 1").select("id"), "id", how))
    assert "BroadcastHashJoin" in _plan(other.join(F.broadcast(few), "id"))
    assert other.join(held, "id").count() == 300_000


def test_small_tables_are_left_to_spark(spark):
    assert "BroadcastHashJoin" in _plan(spark.range(300_000).join(tables.cut(spark.range(10), "few"), "id"))
