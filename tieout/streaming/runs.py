"""Exports that arrive as a stream: each micro-batch is a run, and the worklist carries what stays open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tieout.conf import Settings
from tieout.operators.worklist import Worklist
from tieout.plans.engine import reconcile
from tieout.schema import ENTRY


def reconcile_stream(spark: SparkSession, folder: str, worklist: str, checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:
    """Reconcile Parquet entries as they arrive in ``folder`` and merge each batch into ``worklist``, once each.

    A batch that is replayed after a failure has the run id it had before, and a run that the worklist
    already holds is passed over, so items are not counted twice.
    """
    held = Worklist(spark, worklist)

    def run(batch: DataFrame, number: int) -> None:
        name = f"batch-{number}"
        if held.history().where(f"run = '{name}'").limit(1).count() or held.items().where(f"last_run = '{name}'").limit(1).count():
            return
        result = reconcile(batch, settings)
        held.record(result.exceptions, result.groups, batch, name)

    rows = spark.readStream.schema(ENTRY).parquet(folder)
    return rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
