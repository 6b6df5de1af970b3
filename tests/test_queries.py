"""Queries against their SQL on the smallest tables."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from tieout.plans.queries import ORACLES, QUERIES  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
FAST = [
    "scan_union_entries", "parse_amount", "parse_date", "mine_reference", "fee_breakdown", "money_format", "priority_fingerprint", "quality_issues", "quality_rollup", "disambiguate_ids",
    "ingest_payments", "exact_reference_edges", "deduction_links", "over_refund", "candidate_pairs", "pair_scores", "near_amount_semi", "near_amount_anti", "pair_precision_recall",
    "value_precision", "worklist_merge", "worklist_events", "worklist_page", "worklist_summary", "connected_components", "split_batch", "money_summary",
    "rate_card_override", "refused_deductions", "plausible_groups", "run_aggregate", "money_shares", "top_categories",
    "normalized_sources", "quality_branches", "referenced_pairs", "worklist_reopen", "queue_items",
    "sql_functions", "gateway_entries", "torn_records", "reconcile_planted",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_query_agrees_with_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    ran = duck.execute(ORACLES[name])
    names = [c[0] for c in ran.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted((tuple(r[i] for i in order) for r in ran.fetchall()), key=key)
    got = sorted((tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=key)
    assert got == want and got


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
