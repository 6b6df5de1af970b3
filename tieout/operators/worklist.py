"""The exception worklist that runs carry forward: a merge of snapshots, states, filters and summary."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.functions.scalars import exception_key, priority
from tieout.tables import cut, discard

# States and what may follow each.
TRANSITIONS = {
    "open": ("investigating", "resolved", "written_off"),
    "investigating": ("open", "resolved", "written_off"),
    "resolved": ("open",),
    "written_off": ("open",),
}
GROUP_CATEGORIES = {"payout_overdue": "missing_in_bank", "unbooked_payout": "missing_in_ledger", "ambiguous_split": "split_settlement", "partial": "unknown"}
SORTS = ["amount", "category", "currency", "priority", "source", "status", "times_seen", "updated_run", "value_date"]
ITEM = (
    "fingerprint string, entry_id string, source string, category string, amount bigint, currency string, value_date date, conf double, priority string,"
    " status string, rationale string, first_run string, last_run string, times_seen bigint, assignee string"
)


def queue_items(exceptions: DataFrame, groups: DataFrame, entries: DataFrame) -> DataFrame:
    """SO6, CL4: what a person has to look at: exceptions, and groups whose loop isn't closed, under their first id."""
    e = exceptions.select(F.col("id").alias("entry_id"), "source", "category", "amount", "currency", "value_date", "conf", "rationale")
    category = F.create_map(*[F.lit(x) for p in GROUP_CATEGORIES.items() for x in p])[F.col("status")]
    g = groups.withColumn("category", category).where("category is not null").withColumn("entry_id", F.array_min("entry_ids"))
    first = entries.select(F.col("id").alias("entry_id"), "source", "value_date", "ord").groupBy("entry_id").agg(F.min_by(F.struct("source", "value_date"), "ord").alias("f"))
    g = g.join(first, "entry_id").select("entry_id", "f.source", "category", "amount", "currency", "f.value_date", F.col("confidence").alias("conf"), F.concat(F.array_join("sources", "+"), F.lit(": "), F.col("status")).alias("rationale"))
    items = e.unionByName(g)
    return items.withColumn("fingerprint", exception_key(F.col("entry_id"), F.col("category"), F.col("amount"), F.col("currency"))).dropDuplicates(["fingerprint"])


def merge(worklist: DataFrame, items: DataFrame, entries: DataFrame, run: str) -> tuple[DataFrame, DataFrame]:
    """ST1 to ST3: (new worklist, events) after a run that raised ``items`` over ``entries``.

    One lookup of covered entries by the old items, then one full outer join by fingerprint, in this order, so
    that no row with both sides' columns is shuffled. New items open; seen ones are counted and, if resolved,
    reopened; open ones that the run covered and didn't raise are resolved.
    """
    old = worklist.select(*[F.col(c).alias(f"o_{c}") for c in worklist.columns])
    new = items.select(*[F.col(c).alias(f"n_{c}") for c in items.columns])
    covered = entries.select(F.col("id").alias("c_id")).distinct()
    old = old.join(covered, F.col("o_entry_id") == F.col("c_id"), "left")
    j = old.join(new, F.col("o_fingerprint") == F.col("n_fingerprint"), "full_outer")
    is_new, seen = F.col("o_fingerprint").isNull(), F.col("o_fingerprint").isNotNull() & F.col("n_fingerprint").isNotNull()
    gone = F.col("n_fingerprint").isNull() & F.col("c_id").isNotNull() & F.col("o_status").isin("open", "investigating")
    event = F.when(is_new, "created").when(seen & (F.col("o_status") == "resolved"), "reopened").when(gone, "auto_resolved")
    pick = lambda c: F.when(is_new, F.col(f"n_{c}")).otherwise(F.col(f"o_{c}")).alias(c)
    fresh = lambda c: F.coalesce(f"n_{c}", f"o_{c}").alias(c)
    status = F.when(is_new | (seen & (F.col("o_status") == "resolved")), "open").when(gone, "resolved").otherwise(F.col("o_status"))
    j = j.withColumn("event", event)
    merged = j.select(
        pick("fingerprint"), pick("entry_id"), pick("source"), pick("category"), pick("amount"), pick("currency"), pick("value_date"), fresh("conf"),
        F.when(is_new, priority(F.col("n_category"), F.col("n_amount"))).otherwise(F.col("o_priority")).alias("priority"), status.alias("status"), fresh("rationale"),
        F.when(is_new, F.lit(run)).otherwise(F.col("o_first_run")).alias("first_run"), F.when(is_new | seen | gone, F.lit(run)).otherwise(F.col("o_last_run")).alias("last_run"),
        (F.coalesce("o_times_seen", F.lit(0)) + (is_new | seen).cast("long")).alias("times_seen"), F.col("o_assignee").alias("assignee"),
    )
    events = j.where("event is not null").select(F.coalesce("n_fingerprint", "o_fingerprint").alias("fingerprint"), "event", F.lit(run).alias("run"), F.when(~is_new, F.when(gone, "open").otherwise("resolved")).alias("from_status"), status.alias("to_status"))
    return merged, events


def page(worklist: DataFrame, sort: str = "amount", descending: bool = True, limit: int = 50, offset: int = 0, search: str | None = None, **equal) -> DataFrame:
    """PR10, SL2: a page of the worklist. equal: column=value, with ``min_``/``max_`` for ranges; falsy values don't filter."""
    if sort not in SORTS:
        raise ValueError(f"can't sort by {sort}")
    key = F.col("last_run" if sort == "updated_run" else sort)
    order = key.desc() if descending else key.asc()
    return _filtered(worklist, search, **equal).orderBy(order, "fingerprint").offset(max(0, offset)).limit(min(max(1, limit), 500))


def _filtered(worklist: DataFrame, search: str | None = None, **equal) -> DataFrame:
    for column, value in equal.items():
        if value in (None, "", 0):
            continue
        if column.startswith("min_"):
            worklist = worklist.where(F.col(column[4:]) >= value)
        elif column.startswith("max_"):
            worklist = worklist.where(F.col(column[4:]) <= value)
        else:
            worklist = worklist.where(F.col(column) == value)
    if search:
        worklist = worklist.where(F.col("entry_id").contains(search) | F.lower("rationale").contains(search.lower()) | F.lower("category").contains(search.lower()))
    return worklist


def total(worklist: DataFrame, **filters) -> int:
    """SL2: how many items the filters of :func:`page` leave, whatever the page."""
    return _filtered(worklist, **filters).count()


def summary(worklist: DataFrame) -> DataFrame:
    """AG13: by status and category: items, value, and how many were carried forward."""
    return worklist.groupBy("status", "category").agg(F.count("*").alias("items"), F.sum("amount").alias("value"), F.count_if(F.col("times_seen") > 1).alias("carried"))


def batch_digest(rows: DataFrame) -> DataFrame:
    """FN24: one row, a digest of ``rows`` in any order, from sums that each task adds up."""
    h = F.sum(F.xxhash64(*sorted(rows.columns)).cast("decimal(38,0)"))
    return rows.agg(F.substring(F.sha2(F.concat_ws("|", F.coalesce(h, F.lit(0)).cast("string"), F.count("*").cast("string")), 256), 1, 16).alias("digest"))


def record_run(path: str, run: str, batch: DataFrame, metrics: DataFrame) -> None:
    """ST7: append a row to the ledger of runs: id, time, a digest of the entries in any order, and the run's metrics.

    Rows are never changed; the same input run twice is two rows with one digest.
    """
    batch_digest(batch).join(metrics).select(F.lit(run).alias("run"), F.current_timestamp().alias("ts"), "digest", *metrics.columns).write.mode("append").parquet(path)


EVENT = "fingerprint string, event string, run string, from_status string, to_status string, body string"
#: Logged versions after which a commit writes the whole list anew.
COMPACT = 16
#: Times that a change is worked out again because others' changes came first.
RETRIES = 20


class Conflict(RuntimeError):
    """Another change took the version that this one was to be."""


class Worklist:
    """The worklist as a log of versions in a folder.

    A version is a folder of its events and either the items it changed or, now and then, all items. A
    change is worked out from the versions so far, written aside, and moved to the next number; the move
    fails where that number is taken, and the change is then worked out again from what is there now. So
    readers see whole versions only, no change is lost, and changing an item writes one row.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, name: str = "") -> list[str]:
        where = self._path(name)
        fs = where.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []

    def _versions(self) -> list[int]:
        return sorted(int(n[2:]) for n in self._names() if n.startswith("v="))

    def items(self, upto: int | None = None) -> DataFrame:
        """All items as of a version, the last one if none is given."""
        versions = [v for v in self._versions() if upto is None or v <= upto]
        whole = next((v for v in reversed(versions) if "items" in self._names(f"v={v}")), None)
        changed = [f"{self.path}/v={v}/changes" for v in versions if whole is None or v > whole]
        if whole is None and not changed:
            return self.spark.createDataFrame([], ITEM)
        base = self.spark.read.schema(ITEM).parquet(f"{self.path}/v={whole}/items") if whole is not None else None
        if not changed:
            return base
        version = F.regexp_extract("_metadata.file_path", "/v=(\\d+)/changes", 1).cast("int")
        changes = self.spark.read.schema(ITEM).parquet(*changed).withColumn("_v", version)
        last = changes.groupBy("fingerprint").agg(F.max_by(F.struct(*[c for c in changes.columns if c not in ("fingerprint", "_v")]), "_v").alias("last")).select("fingerprint", "last.*")
        return last if base is None else base.join(changes.select("fingerprint"), "fingerprint", "left_anti").unionByName(last)

    def history(self, fingerprint: str | None = None) -> DataFrame:
        """ST6, SL4: events, of one item or all, each with its version, which orders them."""
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], f"{EVENT}, v int")
        version = F.regexp_extract("_metadata.file_path", "/v=(\\d+)/events", 1).cast("int").alias("v")
        events = self.spark.read.schema(EVENT).parquet(*[f"{self.path}/v={v}/events" for v in versions]).select("*", version)
        return events if fingerprint is None else events.where(F.col("fingerprint") == fingerprint).orderBy("v")

    def runs(self, limit: int = 50) -> DataFrame:
        """SL3, SL5: runs recorded by :meth:`record`, newest first, 1 to 200 of them: (run, v, events)."""
        kept = self.history().where("run is not null and event <> 'assign'").groupBy("run").agg(F.min("v").alias("v"), F.count("*").alias("events"))
        return kept.orderBy(F.desc("v")).limit(min(max(1, limit), 200))

    def _commit(self, read: int, changes: DataFrame, events: DataFrame, whole: bool = False) -> int:
        """Write the version after ``read``, or raise Conflict where there is one."""
        staged = f"_staged-{uuid.uuid4().hex}"
        changes.write.parquet(f"{self.path}/{staged}/{'items' if whole else 'changes'}")
        (events if "body" in events.columns else events.withColumn("body", F.lit(None).cast("string"))).select(*[f.split()[0] for f in EVENT.split(", ")]).write.parquet(f"{self.path}/{staged}/events")
        jvm, gateway = self.spark._jvm, self.spark.sparkContext._gateway
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), self.spark._jsparkSession.sessionState().newHadoopConf())
        plain = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # don't overwrite
        try:
            files.rename(self._path(staged), self._path(f"v={read + 1}"), plain)
        except Py4JJavaError as e:
            files.delete(self._path(staged), True)
            if "FileAlreadyExists" in e.java_exception.getClass().getName() or read + 1 in self._versions():
                raise Conflict(f"version {read + 1} was written by another change") from e
            raise
        return read + 1

    def _change(self, work: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> int:
        """Commit what ``work`` makes of the items, (changed items, events), as often as it takes to be next."""
        for _ in range(RETRIES):
            versions = self._versions()
            read = versions[-1] if versions else 0
            try:
                made = self._commit(read, *work(self.items(read)))
            except Conflict:
                continue
            if made % COMPACT == 0:
                self.compact()
            return made
        raise Conflict(f"no luck in {RETRIES} tries")

    def compact(self) -> None:
        """Write all items as the next version, unless another change comes first; earlier versions stay for the history."""
        read = (self._versions() or [0])[-1]
        try:
            self._commit(read, self.items(read), self.spark.createDataFrame([], EVENT), whole=True)
        except Conflict:
            pass  # whoever came first will, or the next change does

    def record(self, exceptions: DataFrame, groups: DataFrame, entries: DataFrame, run: str | None = None) -> str:
        """ST1 to ST3: merge what a run raised; only items that it touched are written."""
        run = run or uuid.uuid4().hex[:12]
        raised = cut(queue_items(exceptions, groups, entries), "raised")

        def work(items: DataFrame) -> tuple[DataFrame, DataFrame]:
            merged, events = merge(items, raised, entries, run)
            return merged.where(F.col("last_run") == run), events

        self._change(work)
        discard(raised)
        return run

    def _one(self, fingerprint: str, event: Callable[[str], tuple[str, str | None]], **values: str | None) -> None:
        """Change one item: one row of items, one event. event(status) gives its kind and body."""

        def work(items: DataFrame) -> tuple[DataFrame, DataFrame]:
            mine = items.where(F.col("fingerprint") == fingerprint)
            held = mine.select("status").first()
            if held is None:
                raise KeyError(fingerprint)
            kind, body = event(held[0])
            new = mine.withColumns({c: F.lit(v).cast("string") for c, v in values.items()})
            return new.select(mine.columns), self.spark.createDataFrame([(fingerprint, kind, None, held[0], values.get("status", held[0]), body)], EVENT)

        self._change(work)

    def move(self, fingerprint: str, status: str, reason: str | None = None) -> None:
        """ST4: another state; a step that TRANSITIONS lacks raises, whatever changed in between."""

        def event(held: str) -> tuple[str, str | None]:
            if status not in TRANSITIONS or status != held and status not in TRANSITIONS[held]:
                raise ValueError(f"{held} can't become {status}")
            return "status", reason

        self._one(fingerprint, event, status=status)

    def note(self, fingerprint: str, body: str) -> None:
        """ST5: a note of at most 4,000 characters."""
        if not (body or "").strip():
            raise ValueError("the note is empty")
        self._one(fingerprint, lambda _: ("note", body.strip()[:4000]))

    def assign(self, fingerprint: str, assignee: str | None) -> None:
        """ST5: who works on an item; None for nobody."""
        self._one(fingerprint, lambda _: ("assign", f"assigned to {assignee}" if assignee else "unassigned"), assignee=assignee or None)
