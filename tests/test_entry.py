"""The contract of the entry module, and queries beside their SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from attest import catalog
from attest.fixtures import TABLES

SF = os.environ.get("ATTEST_SF_DIR", "/root/testdata/sf0.001")
#: Small, quick and different; bench and the driver run all.
CHECKED = ["doc_dedup", "entity_build", "triple_upsert", "approval_apply", "claim_rules", "resolve_verdict", "retrieve_topk", "conflict_single", "conflict_polarity", "graph_stats", "extraction_prf", "corpus_statistics", "prose_prf", "verdict_accuracy", "verdict_provenance", "debate_view", "report_view", "status_rollup", "rate_nth_call", "citation_validate"]


def _rows(df):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(round(float(v), 6)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


def test_entry_has_rows(spark):
    found = entry.entry(spark)
    assert found.count() > 0 and "conflict_hash" in found.columns


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries()) and len(catalog.QUERIES) > 110


@pytest.mark.parametrize("name", CHECKED)
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), con.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
