"""Streams against one batch over all rows, with files out of order and files that come twice."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tieout.operators import worklist
from tieout.operators.settlement import late_candidates
from tieout.operators.solver import unique_links
from tieout.schema import as_entries
from tieout.streaming.runs import reconcile_stream
from tieout.streaming.state import late_payout_stream, worklist_stream

D = dt.date(2026, 1, 1)


def write(spark, path, rows, kind):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)


def drained(stream, path, schema):
    """All that a stream gives for what is there now, one file a micro-batch."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(schema).parquet(f"{path}/out")


SALE = "unit long, currency string, value long, day date, valid_from date, valid_to date"
PAYOUT = "anchor long, currency string, target long, day date"


def test_late_payouts(spark, tmp_path):
    rng = random.Random(3)
    sales = [(u, "INR", rng.randint(1, 60), D + dt.timedelta(rng.randint(0, 200)), dt.date(1, 1, 1), None) for u in range(300)]
    payouts = [(1000 + i, "INR", rng.randint(1, 60), D + dt.timedelta(d)) for i, d in enumerate(sorted(rng.randint(0, 260) for _ in range(120)))]
    rows = [("s", r, r[3]) for r in sales] + [("p", r, r[3]) for r in payouts]
    rows.sort(key=lambda r: (r[2].toordinal() + rng.randint(-2, 2)))  # up to four days out of order, less than the delay
    where = {k: f"{tmp_path}/{k}" for k in "sp"}
    step = 60
    for i in range(0, len(rows), step):
        for k, kind in (("s", SALE), ("p", PAYOUT)):
            part = [r for which, r, _ in rows[i : i + step] if which == k]
            if part:
                write(spark, where[k], part, kind)
                if i % 120 == 0:
                    write(spark, where[k], part, kind)  # sent twice
    far = D + dt.timedelta(900)  # moves the watermark past everything
    write(spark, where["s"], [(99999, "EUR", 1, far, far, None)], SALE)
    write(spark, where["p"], [(99998, "EUR", 2, far, None)][:0] or [(99998, "EUR", 2, far)], PAYOUT)
    read = lambda k, kind: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(where[k])
    got = drained(late_payout_stream(read("s", SALE), read("p", PAYOUT), delay="30 days"), str(tmp_path), "anchor long, unit long")
    anchors = spark.createDataFrame([(a, c, t, d) for a, c, t, d in payouts], "anchor long, currency string, target long, value_date date")
    none = "cast(array() as array<struct<value_date date, amount bigint>>)"
    free = spark.createDataFrame([(u, c, v, [d]) for u, c, v, d, _, _ in sales], "unit long, currency string, base_gross long, pay_dates array<date>").withColumn("events", F.expr(none))
    want = unique_links(late_candidates(anchors, free), repeat=False)
    got, want = (sorted(map(tuple, x.select("anchor", "unit").collect())) for x in (got, want))
    assert got == want and len(want) > 5


RAISED = "run string, at timestamp, entry_id string, fingerprint string"
COVERED = "run string, at timestamp, id string"


def test_worklist_events(spark, tmp_path):
    rng = random.Random(5)
    runs = []
    for r in range(6):
        at = dt.datetime(2026, 1, 1 + r)
        covered = [f"e{i}" for i in range(12) if rng.random() < 0.7]
        raised = [(e, f"{e}|{c}") for e in covered for c in "xy" if rng.random() < 0.4]
        runs.append((f"r{r}", at, covered, raised))
    items, want = spark.createDataFrame([], worklist.ITEM), []
    kind = "entry_id string, fingerprint string"
    for run, _, covered, raised in runs:
        rows = spark.createDataFrame(raised, kind).selectExpr("entry_id", "'payment' source", "'unknown' category", "1L amount", "'INR' currency", "date'2026-01-01' value_date", "0.5D conf", "'' rationale", "fingerprint")
        items, events = worklist.merge(items, rows, spark.createDataFrame([(c,) for c in covered], "id string"), run)
        items = spark.createDataFrame(items.collect(), worklist.ITEM)
        want += [tuple(e) for e in events.select("fingerprint", "event", "run").collect()]
    for run, at, covered, raised in [runs[1], runs[0], runs[0], runs[2], runs[4], runs[3], runs[5], ("end", dt.datetime(2027, 1, 1), ["z"], [("z", "z|x")])]:
        write(spark, f"{tmp_path}/raised", [(run, at, *r) for r in raised], RAISED)
        write(spark, f"{tmp_path}/covered", [(run, at, c) for c in covered], COVERED)
    read = lambda k, kind: spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{k}")
    got = drained(worklist_stream(read("raised", RAISED), read("covered", COVERED), "2 days"), str(tmp_path), worklist.EVENT)
    assert sorted(map(tuple, got.where("run <> 'end'").select("fingerprint", "event", "run").collect())) == sorted(want)
    assert {e for _, e, _ in want} == {"created", "reopened", "auto_resolved"}


def test_each_micro_batch_is_a_run(spark, tmp_path):
    kind = "id string, source string, amount long, value_date date, currency string, ord long"
    for i, day in enumerate((D, D + dt.timedelta(1))):
        as_entries(spark.createDataFrame([("rf_9", "refund", 700, D, "INR", 1), (f"bnk_{i}", "bank", 999999, day, "INR", 2)], kind)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        reconcile_stream(spark, f"{tmp_path}/in", f"{tmp_path}/work", f"{tmp_path}/checkpoint").awaitTermination()
    got = {r.entry_id: (r.status, r.times_seen) for r in worklist.Worklist(spark, f"{tmp_path}/work").items().collect()}
    assert got == {"rf_9": ("open", 2), "bnk_0": ("open", 1), "bnk_1": ("open", 1)}


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
