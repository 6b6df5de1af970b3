"""One object for what a user does: list and run datasets or uploads, keep the worklist and the ledger of runs, evaluate."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.conf import Settings
from tieout.operators import groups as grp
from tieout.operators import reports
from tieout.operators.dispatch import Resolver
from tieout.operators.worklist import Worklist, batch_digest, record_run
from tieout.plans.engine import Result, reconcile
from tieout.sources import ingest
from tieout.sources.sinks import write_result
from tieout.tables import cut, discard


@dataclass
class Service:
    """``root``: folder of named datasets; ``store``: folder of the worklist, the ledger of runs and the evaluations."""

    spark: SparkSession
    root: str
    store: str
    settings: Settings = field(default_factory=Settings)
    agent: Resolver | None = None

    @property
    def worklist(self) -> Worklist:
        return Worklist(self.spark, f"{self.store}/worklist")

    def health(self) -> dict:
        return {"spark": self.spark.version, "datasets": len(self.datasets()), "versions": len(self.worklist._versions())}

    def datasets(self) -> list[str]:
        return ingest.datasets(self.spark, self.root)

    def reconcile(self, name: str, run: str | None = None) -> Result:
        """Reconcile a named dataset, and record the run."""
        return self.reconcile_tables(ingest.load_dataset(self.spark, self.root, name)[0], run)

    def reconcile_files(self, paths: dict[str, str], run: str | None = None) -> Result:
        """Reconcile files by source, and record the run."""
        return self.reconcile_tables({s: ingest.read(self.spark, p) for s, p in paths.items()}, run)

    def reconcile_tables(self, tables: dict[str, DataFrame], run: str | None = None) -> Result:
        """SC7, ST7: exports of too many rows are refused before anything is mapped; the run goes to the ledger and the worklist."""
        entries, _ = ingest.entries_of(ingest.guard(tables, self.settings.max_rows))
        entries = cut(entries, "batch")
        result = reconcile(entries, self.settings, agent=self.agent)
        run = self.worklist.record(result.exceptions, result.groups, entries, run)
        record_run(f"{self.store}/runs", run, entries, result.metrics())
        return result

    def runs(self, limit: int = 50) -> DataFrame:
        """SL3, SL5: the ledger, newest first, 1 to 200 rows."""
        rows = self.spark.read.parquet(f"{self.store}/runs")
        return rows.orderBy(F.desc("ts"), F.desc("run")).limit(min(max(1, limit), 200))

    def evaluate(self, name: str, replay: bool = False) -> DataFrame:
        """AG7 to AG12 of a labelled dataset, one row; the same entries and labels aren't run again.

        Results are kept by a digest of what they come from. replay: run twice and compare fingerprints.
        """
        tables, labels, truth = ingest.load_dataset(self.spark, self.root, name)
        entries = cut(ingest.entries_of(tables)[0], "batch")
        digests = [batch_digest(t).first()[0] if t is not None else "none" for t in (entries, labels, truth)]
        path = f"{self.store}/evaluations/{name}-{'-'.join(digests)}-{abs(hash_of(self.settings)):x}-{int(replay)}"
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).exists(where):
            score(name, entries, labels, truth, self.settings, replay).write.mode("overwrite").parquet(path)
        discard(entries)
        return self.spark.read.parquet(path)

    def evaluation(self, names: list[str] | None = None, replay: bool = False) -> DataFrame:
        """AG11 over datasets, and each one's row: (scores, summary) as one table, the summary labelled ``all``."""
        scores = reduce(DataFrame.unionByName, [self.evaluate(n, replay) for n in names or self.datasets()])
        return reports.run_summary(scores.withColumn("label", F.lit("all")))

    def write(self, result: Result, path: str) -> None:
        write_result(result, path)


def hash_of(settings: Settings) -> int:
    """A number of the settings that stays the same from one process to the next."""
    return int.from_bytes(uuid.uuid5(uuid.NAMESPACE_OID, repr(settings)).bytes[:8], "big")


def score(label: str, entries: DataFrame, labels: DataFrame | None, truth: DataFrame | None, settings: Settings = Settings(), replay: bool = False) -> DataFrame:
    """AG7 to AG10 of one run as a row of :func:`tieout.operators.reports.run_summary`; null where there are no labels."""
    began = time.time()
    result = reconcile(entries, settings)
    seconds = time.time() - began
    metrics = result.metrics()
    members = cut(result.groups.select("group_id", "stage", F.explode("entry_ids").alias("id")), "members")
    resolved = members.agg(F.bround(F.coalesce(F.count_if(F.col("stage").isin("heuristic", "agent")) / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)), 4).alias("resolver_share"))
    row = metrics.join(resolved)
    none = [F.lit(None).cast("double").alias(c) for c in ("precision", "recall", "f1", "value_precision")]
    if labels is not None:
        predicted = members.select("id", F.col("group_id").alias("grp"))
        value = grp.value_precision(predicted.join(entries.select("id", "amount"), "id"), labels)
        share = F.when(F.col("value") > 0, F.bround(F.col("right_value") / F.col("value"), 4)).otherwise(1.0).alias("value_precision")
        row = row.join(grp.pair_scores(predicted, labels).select("precision", "recall", "f1")).join(value.select(share, "false_match_cost"))
    else:
        row = row.select("*", *none, F.lit(0).cast("long").alias("false_match_cost"))
    if truth is not None:
        told = grp.category_accuracy(result.exceptions, truth)
        row = row.join(told.select(F.when(F.col("labelled") > 0, F.bround(F.col("hits") / F.col("labelled"), 4)).otherwise(1.0).alias("category_accuracy")))
    else:
        row = row.withColumn("category_accuracy", F.lit(None).cast("double"))
    stable = reconcile(entries, settings).fingerprint().first() == result.fingerprint().first() if replay else None
    return row.select("*", F.lit(label).alias("label"), F.lit(stable).cast("boolean").alias("replay_stable"), F.lit(seconds).alias("seconds"))
