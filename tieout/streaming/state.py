"""Streams whose state Spark keeps by key, with timers in event time: late payouts, and the worklist.

What arrives waits in its key's state until the watermark has passed its date, and is then taken in order
of dates. So files that come out of order, within the watermark's delay, or twice, give what one batch over
all of them gives. State lives in Spark's own store and checkpoint; nothing is rewritten as a table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tieout.conf import Settings
from tieout.operators.worklist import EVENT

DAY_MS = 86_400_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOREVER = 1 << 40


def _keyed(rows: DataFrame, keys: list[str], time: str, delay: str, processor: StatefulProcessor, schema: str) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    timed = rows.withWatermark(time, delay)
    return timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "eventtime")


class _LatePayouts(StatefulProcessor):
    """Sales and payouts of one currency and amount. Dates are days since the epoch."""

    def __init__(self, longest: int) -> None:
        self.longest = longest

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sales = handle.getMapState("sales", "unit long", "day long, valid_from long, valid_to long, taken boolean")
        self.payouts = handle.getMapState("payouts", "anchor long", "day long, done boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                held, value = (self.sales, (r.day, r.valid_from, r.valid_to, False)) if r.kind == "sale" else (self.payouts, (r.day, False))
                name = (int(r.number),)
                if not held.containsKey(name):  # sent again: nothing new
                    held.updateValue(name, value)
                    # a payout is decided once every sale up to its day is in; all leave when no payout can ask for them
                    self.handle.registerTimer((int(r.day) + 1 + (self.longest if r.kind == "sale" else 0)) * DAY_MS)
        yield pd.DataFrame({"anchor": pd.Series(dtype="int64"), "unit": pd.Series(dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = expiredTimerInfo.getExpiryTimeInMs() // DAY_MS  # all days before this one are complete
        sales = {k[0]: v for k, v in self.sales.iterator()}
        payouts = {k[0]: v for k, v in self.payouts.iterator()}
        out = []
        for anchor, (day, done) in sorted(payouts.items(), key=lambda p: (p[1][0], p[0])):
            if done or day >= before:
                continue
            fits = [u for u, (d, begin, end, taken) in sales.items() if not taken and day - self.longest <= d <= day and begin <= day < end]
            if len(fits) == 1:
                out.append((anchor, fits[0]))
                sales[fits[0]] = (*sales[fits[0]][:3], True)
                self.sales.updateValue((fits[0],), sales[fits[0]])
            self.payouts.updateValue((anchor,), (day, True))
            self.handle.registerTimer((day + 1 + self.longest) * DAY_MS)
        for held, rows in ((self.sales, sales), (self.payouts, payouts)):
            for k, v in rows.items():
                if v[0] + self.longest < before:
                    held.removeKey((k,))
        yield pd.DataFrame(out, columns=["anchor", "unit"]).astype("int64")

    def close(self) -> None:
        pass


def late_payout_stream(sales: DataFrame, payouts: DataFrame, settings: Settings = Settings(), delay: str = "3 days") -> DataFrame:
    """ST8: (anchor, unit) of streams of sales and payouts: a payout's one sale of exactly its amount, paid up to ``max_payout_lag_days`` before.

    sales: (unit, currency, value, day date, valid_from date, valid_to date or null), a row for each amount that
    deductions leave of a sale; payouts: (anchor, currency, target, day date). Payouts are decided in order of
    day, then anchor, when the watermark, ``delay`` behind the latest day, has passed their day.
    """
    number = lambda c: F.unix_date(F.col(c)).cast("long")
    left = sales.select("currency", F.col("value").alias("amount"), F.lit("sale").alias("kind"), F.col("unit").alias("number"), number("day").alias("day"), F.col("day").cast("timestamp").alias("at"), number("valid_from").alias("valid_from"), F.coalesce(number("valid_to"), F.lit(FOREVER)).alias("valid_to"))
    none = F.lit(0).cast("long")
    right = payouts.select("currency", F.col("target").alias("amount"), F.lit("payout").alias("kind"), F.col("anchor").alias("number"), number("day").alias("day"), F.col("day").cast("timestamp").alias("at"), none.alias("valid_from"), none.alias("valid_to"))
    return _keyed(left.unionByName(right), ["currency", "amount"], "at", delay, _LatePayouts(settings.max_payout_lag_days), "anchor long, unit long")


class _Items(StatefulProcessor):
    """Items of one entry: what runs raised of it, in order of the runs' times."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.items = handle.getMapState("items", "fingerprint string", "status string, times_seen long, first_run string, last_run string")
        self.waiting = handle.getMapState("waiting", "at long, run string", "raised array<string>")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.last.get()[0] if self.last.exists() else -1
        for pdf in rows:
            for at, run, fingerprint in zip(pdf["ms"], pdf["run"], pdf["fingerprint"]):
                if at <= done:  # of a run that was taken already
                    continue
                name = (int(at), run)
                held = list(self.waiting.getValue(name)[0]) if self.waiting.containsKey(name) else []
                if isinstance(fingerprint, str) and fingerprint not in held:
                    held.append(fingerprint)
                self.waiting.updateValue(name, (held,))
                self.handle.registerTimer(int(at) + 1)
        yield pd.DataFrame(columns=NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs(), []
        for (at, run), (raised,) in sorted(((k, v) for k, v in self.waiting.iterator()), key=lambda w: w[0]):
            if at >= now:
                continue
            items = {k[0]: v for k, v in self.items.iterator()}
            for f in raised:
                status, seen, first, _ = items.get(f, (None, 0, run, run))
                if status in (None, "resolved"):
                    out.append((f, "created" if status is None else "reopened", run, status, "open", None))
                self.items.updateValue((f,), ("open" if status in (None, "resolved") else status, seen + 1, first, run))
            for f, (status, seen, first, _) in items.items():
                if f not in raised and status in ("open", "investigating"):
                    out.append((f, "auto_resolved", run, "open", "resolved", None))
                    self.items.updateValue((f,), ("resolved", seen, first, run))
            self.waiting.removeKey((at, run))
            self.last.update((at,))
        yield pd.DataFrame(out, columns=NAMES)

    def close(self) -> None:
        pass


NAMES = [f.split()[0] for f in EVENT.split(", ")]


def worklist_stream(raised: DataFrame, covered: DataFrame, delay: str = "1 hour") -> DataFrame:
    """ST1 to ST3: the worklist's events (EVENT) from streams of runs.

    raised: (run, at timestamp, entry_id, fingerprint); covered: (run, at, id), entries that a run held. A run is
    taken when the watermark has passed its time, runs in order of their times. An entry that a run covers has
    its open items resolved unless the run raises them; a run that comes twice counts once.
    """
    ms = F.unix_millis("at").alias("ms")
    left = raised.select("entry_id", "run", "at", ms, "fingerprint")
    right = covered.select(F.col("id").alias("entry_id"), "run", "at", ms, F.lit(None).cast("string").alias("fingerprint"))
    return _keyed(left.unionByName(right), ["entry_id"], "at", delay, _Items(), EVENT)
