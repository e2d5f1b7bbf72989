"""The SQL of the detectors' stream states the rule on events after the noise filter."""

from __future__ import annotations

import datetime

import duckdb

from fleetglass import oracles, queries
from fleetglass.operators import anomaly
from fleetglass.plans import jobs


def test_hours_of_suspect_fixes_are_not_usual_ones(spark, tmp_path):
    # one vehicle drives for half an hour after midnight and two minutes into the next hour, the last fix a jump (97)
    start = datetime.datetime(2024, 1, 1)
    rows = [(k, start + datetime.timedelta(seconds=k), 8) for k in range(67, 98)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    c.execute("CREATE TABLE customer (c_custkey BIGINT, c_nationkey INT)")
    told = c.execute(f"SELECT vehicle_id, ts FROM ({oracles.oracle_sql()['stream_signals']}) WHERE code = 'NIGHT_MOVEMENT'").fetchall()
    events = queries._trusted_events(spark, str(tmp_path))
    found = anomaly.night_moves(events, jobs.baselines(events)).select("vehicle_id", "ts").collect()
    assert len(found) == 2
    assert sorted(told) == sorted(tuple(r) for r in found)
