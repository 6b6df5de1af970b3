"""The service: datasets through guard, engine, ledger and worklist; evaluation with its cache; the command line."""

import json

import pytest

from tieout.__main__ import main
from tieout.conf import Settings
from tieout.plans import service as module
from tieout.plans.service import Service


@pytest.fixture()
def service(spark, tmp_path):
    folder = tmp_path / "data" / "small"
    folder.mkdir(parents=True)
    (folder / "payments.csv").write_text("id,amount,created_at,order_id\np1,100.00,2026-01-01,O1\np2,50.00,2026-01-01,O2\n")
    (folder / "settlements.csv").write_text("id,amount,fee,tax,settled_at,utr\ns1,97.64,2.00,0.36,2026-01-03,U1\n")
    (folder / "bank.csv").write_text("Txn Date,Narration,Amount,Ref\n2026-01-03,payout,97.64,U1\n2026-01-09,charge,-5.00,\n")
    (folder / "ledger.csv").write_text("id,amount,date,ref\nl1,100.00,2026-01-01,O1\n")
    (folder / "labels.json").write_text(json.dumps({"g1": ["p1", "s1", "bank_0", "l1"]}))
    (folder / "truth.json").write_text(json.dumps({"p2": "missing_in_bank", "bank_1": "duplicate"}))
    return Service(spark, f"file://{tmp_path}/data", f"file://{tmp_path}/store")


def test_runs_are_recorded(service):
    result = service.reconcile("small", "r1")
    assert {(r.group_id, tuple(r.entry_ids), r.status) for r in result.groups.collect()} == {("G0001", ("bank_0", "l1", "p1", "s1"), "complete")}
    groups, exceptions = result.listed()
    assert [r.id for r in exceptions.collect()] == ["p2", "bank_1"] and groups.first().rationale
    service.reconcile("small", "r2")
    assert [(r.run, r.entries, r.exceptions) for r in service.runs().collect()] == [("r2", 6, 2), ("r1", 6, 2)]
    assert service.runs(0).count() == 1 and len({r.digest for r in service.runs().collect()}) == 1
    assert {(r.entry_id, r.times_seen) for r in service.worklist.items().collect()} == {("p2", 2), ("bank_1", 2)}
    assert service.health()["datasets"] == 1
    service.settings = Settings(max_rows=5)
    with pytest.raises(ValueError):
        service.reconcile("small")


def test_evaluation_reads_what_it_has(service, monkeypatch):
    first = service.evaluate("small").first()
    assert (first.precision, first.recall, first.f1, first.value_precision, first.false_match_cost) == (1.0, 1.0, 1.0, 1.0, 0)
    assert first.category_accuracy == 0.5 and first.entries == 6 and first.auto_match_rate == 0.6667

    def never(*_):
        raise AssertionError("run again")

    monkeypatch.setattr(module, "reconcile", never)
    assert service.evaluate("small").first() == first
    told = service.evaluation().first()
    assert (told.label, told.runs, told.precision_mean, told.category_accuracy_mean) == ("all", 1, 1.0, 0.5)


def test_command_line(spark, service, tmp_path, capsys):
    assert main(["--dataset", "small", "--root", service.root, "--store", f"{service.store}-2", "--out", f"file://{tmp_path}/out"], spark) == 0
    metrics, money, fingerprint = map(json.loads, capsys.readouterr().out.strip().splitlines()[-3:])
    assert metrics["entries"] == 6 and money["reconciled"] == 10000 and len(fingerprint["fingerprint"]) == 16
    written = {r.rule for r in spark.read.json(f"file://{tmp_path}/out/audit").collect()}
    assert {"classify-residual@v1", "bank-to-settlement@v1+exact-reference@v2+payment-to-settlement@v1"} <= written or "exact-reference@v2+payment-to-settlement@v1" in written
    with pytest.raises(SystemExit):
        main([], spark)
