"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

from fleetglass import oracles, queries

SF = "/root/testdata/sf0.001"
GIVEN = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in GIVEN:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ["norm_outcomes", "norm_events", "clean_noise", "fence_contained", "anomaly_tows", "convoy_groups", "job_baselines", "job_report_figures", "serve_leaderboard", "privacy_events", "monitor_latency"])
def test_query_equals_sql(spark, db, name):
    got, want = queries.queries()[name](spark, SF).toPandas(), db.execute(oracles.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    same = lambda x: sorted(map(tuple, x[columns].astype(str).to_numpy().tolist()))
    assert same(got) == same(want)


def test_every_oracle_has_a_query():
    assert set(oracles.oracle_sql()) <= set(queries.queries())
