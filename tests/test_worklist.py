"""The worklist as a log: runs, moves, notes, conflicts and compaction."""

import datetime as dt

import pytest

from tieout.operators import worklist
from tieout.operators.worklist import Conflict, Worklist
from tieout.sources import sinks

D = dt.date(2026, 1, 1)
RAISED = "id string, source string, category string, amount long, currency string, value_date date, conf double, rationale string"


def run_of(spark, ids):
    """(exceptions, groups, entries) of a run that raises ``ids`` and covers e0 to e5."""
    raised = spark.createDataFrame([(i, "payment", "missing_in_bank", 100 + int(i[1:]), "INR", D, 0.6, "unpaid") for i in ids], RAISED)
    none = spark.createDataFrame([], "entry_ids array<string>, sources array<string>, amount long, currency string, confidence double, status string")
    entries = spark.createDataFrame([(f"e{i}", "payment", D, i) for i in range(6)], "id string, source string, value_date date, ord long")
    return raised, none, entries


def key(work, entry):
    return work.items().where(f"entry_id = '{entry}'").first().fingerprint


def test_runs_and_changes(spark, tmp_path):
    work = Worklist(spark, str(tmp_path / "w"))
    assert work.items().count() == work.history().count() == 0
    work.record(*run_of(spark, ["e1", "e2", "e3"]), "r1")
    one, two = key(work, "e1"), key(work, "e2")
    work.move(one, "resolved", "paid")
    with pytest.raises(ValueError):
        work.move(one, "investigating")
    with pytest.raises(ValueError):
        work.move(one, "no such state")
    with pytest.raises(KeyError):
        work.move("nobody", "open")
    work.note(two, "  call them  ")
    work.note(two, "x" * 5000)
    with pytest.raises(ValueError):
        work.note(two, "   ")
    work.assign(two, "kim")
    assert work.items().where("entry_id = 'e2'").first().assignee == "kim"
    work.assign(two, None)
    work.record(*run_of(spark, ["e1", "e2", "e4"]), "r2")
    got = {r.entry_id: (r.status, r.times_seen, r.first_run, r.last_run, r.assignee) for r in work.items().collect()}
    assert got == {"e1": ("open", 2, "r1", "r2", None), "e2": ("open", 2, "r1", "r2", None), "e3": ("resolved", 1, "r1", "r2", None), "e4": ("open", 1, "r2", "r2", None)}
    assert [(r.event, r.body and len(r.body)) for r in work.history(two).collect()] == [("created", None), ("note", 9), ("note", 4000), ("assign", 15), ("assign", 10)]
    assert [r.event for r in work.history(one).collect()] == ["created", "status", "reopened"]
    assert [r.run for r in work.runs().collect()] == ["r2", "r1"] and work.runs(0).count() == 1


def test_a_move_writes_one_row(spark, tmp_path):
    work = Worklist(spark, str(tmp_path / "w"))
    work.record(*run_of(spark, ["e1", "e2", "e3"]), "r1")
    work.move(key(work, "e1"), "investigating")
    assert spark.read.parquet(f"{tmp_path}/w/v=2/changes").count() == 1


def test_concurrent_changes_are_all_kept(spark, tmp_path):
    other = Worklist(spark, str(tmp_path / "w"))

    class Late(Worklist):
        """Another change always comes first, once."""

        first = None

        def _commit(self, *args, **kwargs):
            first, self.first = self.first, None
            if first:
                first()
            return super()._commit(*args, **kwargs)

    other.record(*run_of(spark, ["e1", "e2"]), "r1")
    one, two = key(other, "e1"), key(other, "e2")
    late = Late(spark, str(tmp_path / "w"))
    late.first = lambda: other.move(two, "written_off")
    late.move(one, "investigating")
    assert {r.entry_id: r.status for r in late.items().collect()} == {"e1": "investigating", "e2": "written_off"}
    # of one item: the second is checked against what the first made of it
    late.first = lambda: other.move(one, "resolved")
    with pytest.raises(ValueError):
        late.move(one, "written_off")
    # a run beside a note: both
    late.first = lambda: other.note(one, "seen")
    late.record(*run_of(spark, ["e1"]), "r2")
    assert [r.event for r in late.history(one).collect()] == ["created", "status", "status", "note", "reopened"]
    with pytest.raises(Conflict):
        late._commit(0, late.items(), late.history())


def test_compaction_keeps_items_and_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(worklist, "COMPACT", 3)
    work = Worklist(spark, str(tmp_path / "w"))
    work.record(*run_of(spark, ["e1", "e2"]), "r1")
    one = key(work, "e1")
    for status in ("investigating", "open", "resolved"):
        work.move(one, status)
    assert "items" in work._names("v=4") and "changes" in work._names("v=5")
    assert {r.entry_id: r.status for r in work.items().collect()} == {"e1": "resolved", "e2": "open"}
    assert {r.entry_id: r.status for r in work.items(2).collect()} == {"e1": "investigating", "e2": "open"}
    assert work.history(one).count() == 4


def test_pages(spark, tmp_path):
    work = Worklist(spark, str(tmp_path / "w"))
    work.record(*run_of(spark, [f"e{i}" for i in range(6)]), "r1")
    items = work.items()
    assert [r.entry_id for r in worklist.page(items, limit=2, offset=1).collect()] == ["e4", "e3"]
    assert worklist.page(items, limit=0).count() == 1 and worklist.page(items, limit=9999).count() == 6
    assert worklist.total(items, min_amount=103) == 3 and worklist.total(items, search="E2") == 0 and worklist.total(items, search="e2") == 1
    assert worklist.total(items, search="UNPAID", status="", category="missing_in_bank") == 6
    with pytest.raises(ValueError):
        worklist.page(items, sort="rationale")


def test_export(spark, tmp_path):
    work = Worklist(spark, str(tmp_path / "w"))
    work.record(*run_of(spark, ["e1", "e2"]), "r1")
    work.assign(key(work, "e1"), 'kim "k"\nand co')
    sinks.worklist_csv(worklist.page(work.items(), sort="amount"), f"file://{tmp_path}/out")
    text = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))).decode("utf-8")
    lines = text.removeprefix("\ufeff").split("\r\n")
    assert text.startswith('\ufeff"fingerprint","entry_id"') and text.endswith("\r\n") and len(lines) == 4
    assert '"e2","payment","missing_in_bank","1.02","INR"' in lines[1] and '"kim ""k""\nand co"' in lines[2]


def test_merge_shuffles_no_joined_rows(spark):
    """Covered entries are looked up before old and new items meet; what items become doesn't change."""
    old = spark.createDataFrame([("f0", "e0", "open"), ("f1", "e1", "open"), ("f2", "e2", "resolved")], "fingerprint string, entry_id string, status string")
    held = spark.createDataFrame([], worklist.ITEM).unionByName(old, allowMissingColumns=True).fillna(1, ["times_seen"])
    items = spark.range(2, 4).selectExpr("concat('e', id) entry_id", "'payment' source", "'unknown' category", "id amount", "'INR' currency", "date '2026-01-01' value_date", "0.5D conf", "'x' rationale", "concat('f', id) fingerprint")
    merged, _ = worklist.merge(held, items, spark.createDataFrame([("e0",), ("e3",)], "id string"), "r2")
    plan = merged._jdf.queryExecution().optimizedPlan().toString()  # top first
    assert plan.index("Join FullOuter") < plan.index("Join LeftOuter")
    got = {r.fingerprint: (r.status, r.times_seen) for r in merged.collect()}
    assert got == {"f0": ("resolved", 1), "f1": ("open", 1), "f2": ("open", 2), "f3": ("open", 1)}
