"""Files as they come: byte order marks, torn rows, things that are no records, shapes of JSON, gateway pages."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tieout.functions import fees, sql
from tieout.sources import gateway, ingest, quality


def test_csv_with_a_byte_order_mark_torn_rows_and_odd_bytes(spark, tmp_path):
    path = tmp_path / "payments.csv"
    path.write_bytes(b"\xef\xbb\xbfPayment Id,Amount,Created At\np1,1.50,2026-01-01\np2,2.50\np3,3.50,2026-01-03,more\np\xff4,4.50,2026-01-04\n")
    rows = ingest.read(spark, str(path))
    assert rows.columns == ["Payment Id", "Amount", "Created At", quality.CORRUPT]
    made, assessed = ingest.entries_of({"payment": rows})
    assert {(r.id, r.amount) for r in made.collect()} == {("p1", 150), ("p3", 350), ("p�4", 450)}
    said = {(r.id, i.field, i.problem, i.severity) for r in assessed.collect() for i in r.issues}
    assert said == {("p2", "row", "torn: not as many fields as headings", "warning"), ("p2", "date", "missing", "error"), ("p3", "row", "torn: not as many fields as headings", "warning")}


def test_json_in_all_shapes(spark, tmp_path):
    held = [{"id": "a", "amount": 500, "created_at": "2026-01-01"}, 7, "x", {"id": "b", "amount": 5.5, "created_at": "2026-01-02", "extra": {"n": 1}}, [1]]
    for name, text in (("a.json", held), ("b.json", {"items": held}), ("c.json", {"count": 5, "rows": held})):
        (tmp_path / name).write_text("﻿" + json.dumps(text), encoding="utf-8")
        made, assessed = ingest.entries_of({"payment": ingest.read(spark, str(tmp_path / name))})
        assert {(r.id, r.amount) for r in made.collect()} == {("a", 500), ("b", 550)}
        assert assessed.where("not accepted").select(F.col("issues")[0].problem).distinct().collect() == [("not a record",)] and assessed.where("not accepted").count() == 3
        assert quality.summary(assessed).first()[:4] == (5, 2, 3, 0)
    (tmp_path / "d.jsonl").write_text('{"id": "a", "amount": "5.00", "created_at": "2026-01-01"}\n\n{"id": "torn", \n')
    made, assessed = ingest.entries_of({"payment": ingest.read(spark, str(tmp_path / "d.jsonl"))})
    assert [(r.id, r.amount) for r in made.collect()] == [("a", 500)] and assessed.count() == 2


def test_gateway_pages(spark):
    day = lambda s: int(dt.datetime.fromisoformat(f"{s}T10:30:00+00:00").timestamp())
    pay = [
        {"id": "p1", "amount": 1000, "currency": "INR", "status": "captured", "captured": True, "created_at": day("2026-07-01"), "method": "card", "fee": 20, "tax": 4, "order_id": "O1"},
        {"id": "p2", "amount": 2000, "status": "authorized", "captured": False, "created_at": day("2026-07-01")},
        {"id": "p3", "amount": 3000, "status": "captured", "created_at": day("2026-07-02"), "notes": []},
        {"id": "p4", "status": "captured", "created_at": "soon"}, "nothing",
    ]
    back = [{"id": "r1", "amount": 300, "payment_id": "p1", "created_at": day("2026-07-03")}]
    paid = [{"id": "s1", "amount": 976, "fees": 20, "tax": 4, "utr": "U1", "created_at": day("2026-07-03")}]
    pages = {s: spark.createDataFrame([(json.dumps(p),)], "value string") for s, p in (("payment", {"items": pay}), ("refund", back), ("settlement", {"rows": paid}))}
    made, assessed = gateway.entries_of(pages)
    got = {r.id: (r.source, r.amount, str(r.value_date), r.reference, r.related, r.fee, r.tax, r.provenance) for r in made.collect()}
    assert got == {
        "p1": ("payment", 1000, "2026-07-01", "O1", None, 20, 4, "gateway"), "p3": ("payment", 3000, "2026-07-02", "p3", None, 0, 0, "gateway"),
        "r1": ("refund", 300, "2026-07-03", "r1", "p1", 0, 0, "gateway"), "s1": ("settlement", 976, "2026-07-03", "U1", None, 20, 4, "gateway"),
    }
    assert {(r.id, tuple(i.problem for i in r.issues)) for r in assessed.where("not accepted").collect()} == {("p4", ("missing", "not a date")), (None, ("not a record",))}


def test_datasets_with_truth(spark, tmp_path):
    folder = tmp_path / "small"
    folder.mkdir()
    (folder / "payments.csv").write_text("id,amount,date\np1,1.00,2026-01-01\n")
    (folder / "labels.json").write_text('{"g1": ["p1", "s1"]}')
    (folder / "truth.json").write_text('{"p1": "missing_in_bank", "b1": "duplicate"}')
    tables, labels, truth = ingest.load_dataset(spark, str(tmp_path), "small")
    assert set(tables) == {"payment"} and labels.count() == 2
    assert set(map(tuple, truth.collect())) == {("p1", "missing_in_bank"), ("b1", "duplicate")}


def test_preview(spark):
    rows = spark.createDataFrame([(f"p{i}", "1.00" if i else "x", "2026-01-01") for i in range(9)], "id string, amount string, date string")
    found, told, samples = ingest.preview(rows, "payment")
    assert found.usable and told.first()[:3] == (9, 8, 1) and [r.id for r in samples.collect()] == ["p1", "p2", "p3"]
    assert ingest.preview(rows.drop("amount"), "payment")[1:] == (None, None)


def test_legs_of_a_batch_are_compiled(spark):
    """A function over the array of legs would be interpreted, with the whole array."""
    from tieout.plans import queries
    from tieout.sources import derived

    for made in (derived.batch(spark, "/root/testdata/sf0.001"), queries._planted(spark, "/root/testdata/sf0.001")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Generate explode(" in plan and "filter(array(" not in plan and "array_compact" not in plan


def test_sql_functions_equal_the_columns(spark):
    from tieout.functions import scalars as fn

    sql.register(spark)
    rows = spark.createDataFrame([(s,) for s in ("500", "500.00", "(12.345)", "1,234.5", " ₹7.005 ", "-", "", "x", "1e3", "-8", "(9)", "2026-01-02", "2/1/2026", "02-01-2026", "2 Jan 2026", "2026-01-02T09:00", None)], "s string")
    same = rows.selectExpr("s", "parse_minor(s) a", "parse_day(s) b").select("a", fn.parse_minor(F.col("s")).alias("c"), "b", fn.parse_date(F.col("s")).alias("d"))
    assert same.where("a is distinct from c or b is distinct from d").count() == 0
    numbers = spark.range(-2000, 2000, 7).selectExpr("id n", "element_at(array('INR', 'JPY', 'KWD', 'usd', 'rs.', 'odd'), cast(pmod(id, 6) + 1 as int)) c").withColumn("n", F.col("n") * 98_765)
    money = numbers.selectExpr("*", "format_money(n, c) a", "divide_half_away(n, 14L) b").select("a", fn.format_money(F.col("n"), F.col("c")).alias("x"), "b", fn.divide_half_away(F.col("n"), 14).alias("y"))
    assert money.where("a <> x or b <> y").count() == 0


def test_card_and_steps(spark, tmp_path):
    (tmp_path / "card.json").write_text('{"tds_bps": 10, "rules": {}}')
    assert (fees.withheld(spark, str(tmp_path / "card.json")), fees.withheld(spark), fees.withheld(spark, str(tmp_path / "none"))) == (10, 0, 0)
    kind = "gross long, method string, currency string, reported_fee long, reported_tax long, reported_tds long, refunds long, chargebacks long"
    sales = spark.createDataFrame([(100_000, "card", "INR", None, None, None, 5_000, 0)], kind)
    told = fees.breakdown(fees.priced(sales, fees.rate_card(spark), tds_bps=10)).first()
    assert told.steps == ["gross: ₹1,000.00", "less fee: ₹20.00", "less tax on the fee: ₹3.60", "less tax withheld: ₹1.00", "less refunds: ₹50.00", "net: ₹925.40 (by the rate card)"]
