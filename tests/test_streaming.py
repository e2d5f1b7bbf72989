"""Streams give what the batch operators give."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from fleetglass.functions import geo
from fleetglass.operators import anomaly, clean, convoy, fence, risk
from fleetglass.schema import SIGNAL
from fleetglass.sources import raw as sources
from fleetglass.streaming import convoys, detectors, pipelines
from tests.test_fleet import GOOD, LAT, LOANS, LON, NOON, arrivals, event


def sent(spark, tmp_path):
    seqs = [1, 3, 2, 2, 4, 9, 5]
    rows = [event(s, vehicle=f"VH-00000{v}", event_id=f"{v}-{s}", ingest_ts=NOON + 500 + i, lat=12.9 + (0.2 if s == 4 else 0)) for v in range(3) for i, s in enumerate(seqs)]
    events = arrivals(spark, rows)
    events.unionByName(pipelines.closing_rows(events, NOON + 9000)).coalesce(1).write.parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))


def test_cleaning_stream_equals_batch(spark, tmp_path):
    events, stream = sent(spark, tmp_path)
    got = []
    pipelines.run_to_end(pipelines.cleaned(stream), lambda batch, _: got.extend(batch.collect()), str(tmp_path / "c"))
    ordered = clean.reorder(events)
    want = clean.flag_noise(ordered.where("outcome = 'normal'"), "position").withColumn("outcome", F.lit("normal")).unionByName(ordered.where("outcome = 'late'").drop("position")).collect()
    key = lambda r: (r["vehicle_id"], r["seq"], r["outcome"], tuple(r["flags"]))
    assert sorted(map(key, got)) == sorted(map(key, want))


def test_dedup_stream(spark, tmp_path):
    _, stream = sent(spark, tmp_path)
    seen = []
    pipelines.run_to_end(pipelines.deduplicated(stream.where("oem <> 'closing'")), lambda batch, _: seen.extend(r["event_id"] for r in batch.collect()), str(tmp_path / "d"))
    assert len(seen) == len(set(seen)) == 18


def test_sinks_repeat_safely(spark, tmp_path):
    events, _ = sent(spark, tmp_path)
    store = pipelines.store_sink(spark, str(tmp_path / "store"))
    for number in (0, 0, 1):
        store(events, number)
    assert spark.read.parquet(str(tmp_path / "store")).count() == 18
    stored = spark.read.parquet(str(tmp_path / "store")).where("day = '2023-11-14'")
    assert "PartitionFilters: [isnotnull(day" in stored._jdf.queryExecution().toString()
    latest = pipelines.latest_sink(spark, str(tmp_path / "latest"))
    for number, part in ((0, "seq < 4"), (1, "seq < 4"), (3, "true"), (3, "true")):  # no version 2, and the last batch again
        latest(events.where(part), number)
    assert {r["seq"] for r in spark.read.parquet(str(tmp_path / "latest/version=3")).collect()} == {9}
    assert sorted(x.name for x in (tmp_path / "latest").iterdir() if x.is_dir()) == ["version=1", "version=3"]
    raw = spark.createDataFrame([(GOOD["A"], NOON, 0), (b"?", NOON, 1)], "payload binary, ingest_ts double, offset long")
    raw.write.parquet(str(tmp_path / "raw"))
    pipelines.run_to_end(pipelines.normalise(sources.raw_stream(spark, str(tmp_path / "raw"))), pipelines.split_sink(str(tmp_path / "split")), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "split/events")).count() == spark.read.parquet(str(tmp_path / "split/dead")).count() == 1


def moving(spark):
    """Two vehicles: parked and carried off past a fence; driving by night, faster at the end, one seq restart."""
    rows = [event(s, lat=LAT + max(0, s - 8) * 0.004, ignition=False, battery_v=3.5 if s == 20 else 4.1) for s in range(1, 24)]
    night = NOON - 6.5 * 3600 + 20 * 3600
    rows += [event(s, ts=night + 30 * s, vehicle="VH-000002", speed_kmh=30.0 if s < 12 else 90.0, flags=["suspect_gps"] if s % 7 == 0 else []) for s in range(1, 30)]
    rows += [event(s, ts=night + 2000 + 30 * s, vehicle="VH-000002", speed_kmh=20.0) for s in range(1, 9)]
    loans = spark.createDataFrame([("VH-000001", 1, 1, 60, "active"), ("VH-000002", 2, 2, 0, "active")], LOANS)
    fences = spark.createDataFrame([(1, LAT, LON), (2, LAT, LON)], "geofence_id long, lat double, lon double").select("geofence_id", geo.circle(F.col("lat"), F.col("lon"), 1500.0).alias("ring"))
    owned = loans.select("vehicle_id", F.col("lender_id").alias("geofence_id"))
    base = spark.createDataFrame([("VH-000002", 8.0, 9.0, 25.0, 2.0)], "vehicle_id string, active_from double, active_to double, avg_speed double, std_speed double")
    return arrivals(spark, rows), loans, owned, fences, base


def in_three_batches(spark, df, order, path):
    """The rows as a stream of three files that are taken one by one."""
    rows = df.orderBy(order).collect()
    for i in range(3):
        spark.createDataFrame(rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3], df.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_detector_streams_equal_batch(spark, tmp_path):
    events, loans, owned, fences, base = moving(spark)
    stream = in_three_batches(spark, events, ["device_ts", "seq"], str(tmp_path / "in"))
    got = []
    pipelines.run_to_end(detectors.signals(stream, owned, fences, base, "0 seconds"), lambda batch, _: got.extend(batch.drop("fired_ts").collect()), str(tmp_path / "c"), settle=True)
    seen = anomaly.movement(events)
    parts = [fence.exits(events, owned, fences), anomaly.tows(seen), anomaly.speed_spikes(seen, base), anomaly.night_moves(events, base), anomaly.tampers(events).drop("fired_ts").withColumn("detail", F.create_map(F.lit("silent_s"), F.lit("900")))]
    want = [r for part in parts for r in part.collect()]
    key = lambda r: (r["vehicle_id"], r["code"], r["ts"], r["lat"], r["strength"], sorted(r["detail"].items()))
    assert sorted(key(r) if r["code"] != "TAMPER_SUSPECTED" else key(r)[:-1] + ([("silent_s", "900")],) for r in got) == sorted(map(key, want))
    assert {r["code"] for r in want} == {"GEOFENCE_EXIT", "TOW_SUSPECTED", "SPEED_SPIKE", "NIGHT_MOVEMENT", "TAMPER_SUSPECTED"}


def test_risk_stream_equals_batch_and_its_sink(spark, tmp_path):
    _, loans, *_ = moving(spark)
    codes = ["TOW_SUSPECTED", "GEOFENCE_EXIT", "TAMPER_SUSPECTED", "NIGHT_MOVEMENT"]
    rows = [(f"VH-00000{1 + i % 2}", codes[i * 7 % 4], NOON + 700 * i, LAT, LON, 0.4 + i % 3 / 5, {"n": str(i)}, NOON + 700 * i) for i in range(24)]
    found = spark.createDataFrame(rows, SIGNAL + ", fired_ts double")
    stream = in_three_batches(spark, found, ["fired_ts"], str(tmp_path / "in"))
    got, sink = [], detectors.decision_sink(str(tmp_path / "out"), loans)

    def take(batch, number):
        got.extend(batch.collect())
        sink(batch, number)
        sink(batch, number)

    pipelines.run_to_end(detectors.decisions(stream, loans), take, str(tmp_path / "c"))
    decided = risk.decide(found, loans).cache()
    assert sorted(map(tuple, got)) == sorted(map(tuple, decided.collect()))
    ids = lambda df, name: sorted(r[name] for r in df.collect())
    assert ids(spark.read.parquet(str(tmp_path / "out/alerts")), "alert_id") == ids(risk.alerts(decided, loans), "alert_id")
    assert ids(spark.read.parquet(str(tmp_path / "out/cases")), "case_id") == ids(risk.cases(decided, loans), "case_id") != []


def test_late_rows_have_a_sink(spark, tmp_path):
    _, stream = sent(spark, tmp_path)
    pipelines.run_to_end(pipelines.cleaned(stream), pipelines.clean_sink(str(tmp_path / "out")), str(tmp_path / "c"))
    kept, late = (spark.read.parquet(str(tmp_path / f"out/{k}")).count() for k in ("events", "late"))
    assert kept + late == 21 and kept > 0


def fleet(spark):
    """Three vehicles that drive together for an hour, one of them away for a while; a fourth joins them; one goes its own way."""
    rows = []
    for run in range(14):
        for v in range(5):
            if (v == 2 and run in (8, 9, 10)) or (v == 3 and run < 3):
                continue
            away = 0.2 if v == 4 else 0.0
            rows.append(event(run, ts=NOON + 300 * run + 20 * v, vehicle=f"VH-00000{v}", lat=LAT + 0.01 * run + 0.0005 * v + away, speed_kmh=40.0, heading_deg=10.0, event_id=f"{v}-{run}"))
    out = arrivals(spark, rows)
    return out.withColumn("geohash", geo.geohash(F.col("lat"), F.col("lon"), 7))


def test_convoy_stream_equals_batch_and_keeps_little(spark, tmp_path):
    events = fleet(spark)
    end = events.limit(1).withColumn("device_ts", F.lit(NOON + 9000.0)).withColumn("vehicle_id", F.lit("VH-999999"))
    stream = in_three_batches(spark, events.unionByName(end), ["device_ts"], str(tmp_path / "in"))
    sink = convoys.convoy_sink(spark, str(tmp_path / "out"))

    def twice(batch, number):
        sink(batch, number)
        sink(batch, number)

    pipelines.run_to_end(convoys.closed_slots(stream, "0 seconds"), twice, str(tmp_path / "c"), settle=True)
    key = lambda r: (r["ts"], r["vehicle_id"], r["lat"], r["lon"], sorted(r["detail"].items()), r["fired_ts"])
    want = sorted(key(r) for r in convoy.live_signals(events).collect())
    assert sorted(key(r) for r in spark.read.parquet(str(tmp_path / "out/signals")).collect()) == want
    assert len({w[0] for w in want}) > 1
    assert all(len([x for x in (tmp_path / f"out/{name}").iterdir() if x.is_dir()]) == 2 for name in ("edges", "members", "positions", "runs"))


class Held:
    """A handle and an expired timer that stand in for the engine's."""

    def __init__(self):
        self.value, self.timers, self.now = None, [], 0

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def deleteTimer(self, at):  # noqa: N802
        self.timers.remove(at)

    def listTimers(self):  # noqa: N802
        return iter(self.timers)

    def getExpiryTimeInMs(self):  # noqa: N802
        return self.now


def test_one_timer_stands_for_an_odd_moment_and_moves():
    held, watch, key = Held(), pipelines.TamperWatch(), ("VH-000001",)
    watch.init(held)
    take = lambda *rows: list(watch.handleInputRows(key, iter([pd.DataFrame(rows).assign(suspect=False)]), None))
    assert take(event(1, ts=NOON), event(2, ts=NOON + 5, battery_v=3.5)) == [] and held.timers == [(NOON + 905) * 1000]
    assert take(event(3, ts=NOON + 500)) == [] and held.timers == [(NOON + 1400) * 1000]
    assert take(event(4, ts=NOON + 950)) == [] and held.timers == []  # the odd moment is too old
    assert take(event(5, ts=NOON + 960, battery_v=3.5)) == [] and held.timers == [(NOON + 1860) * 1000]
    held.now = held.timers.pop()
    fired = pd.concat(watch.handleExpiredTimer(key, None, held))
    assert fired[["code", "ts", "silent_s", "fired_ts"]].to_numpy().tolist() == [["TAMPER_SUSPECTED", NOON + 960, 900, NOON + 1860]]
    assert list(watch.handleExpiredTimer(key, None, held)) == [] and held.timers == []


def odd_moments(rows, clock):
    """The rule read off all rows at once: (ts, silent seconds) of signals."""
    out, session, sessions = [], 0, []
    for i, r in enumerate(rows):
        session += i > 0 and r["seq"] < rows[i - 1]["seq"]
        sessions.append(session)
    point = None
    for i, r in enumerate(rows):
        if point is not None and (sessions[i] != sessions[point] or r["ts"] - rows[point]["ts"] > 900):
            point = None
        best = max(x["volts"] for k, x in enumerate(rows[: i + 1]) if sessions[k] == sessions[i] and x["ts"] >= r["ts"] - 600)
        if point is None and (r["suspect"] or r["volts"] < 3.6 or best - r["volts"] >= 0.2):
            point = i
        after = rows[i + 1]["ts"] if i + 1 < len(rows) else clock
        if point is not None and after - r["ts"] >= 900:
            out.append((rows[point]["ts"], round(after - r["ts"])))
            point = None
    return out


def test_silences_in_pieces_of_any_size():
    rng = random.Random(11)
    for _ in range(300):
        ts, seq, rows = 0.0, 0, []
        for _ in range(rng.randint(1, 40)):
            ts += rng.choice([0, 5, 60, 300, 500, 899, 900, 1500])
            seq = seq + 1 if rng.random() < 0.9 else 0
            rows.append({"ts": ts, "seq": seq, "volts": rng.choice([4.1, 4.1, 4.0, 3.9, 3.5]), "suspect": rng.random() < 0.1})
        clock, state, got, at = ts + rng.choice([0, 1000]), anomaly.Silence(), [], 0
        while at < len(rows):
            part = rows[at : at + rng.randint(1, 15)]
            column = lambda k, part=part: np.array([r[k] for r in part])
            got += state.take(column("ts"), column("seq"), column("ts"), column("ts"), column("volts"), column("suspect"))
            at += len(part)
        got += state.until(clock)
        assert [(t, silent) for t, _, _, silent, _ in got] == odd_moments(rows, clock)


def carried_and_driven(rows):
    """The rules read off each row's own window: (metres carried or None, mean speed or None)."""
    out, session, sessions = [], 0, []
    for i, r in enumerate(rows):
        session += i > 0 and r["seq"] < rows[i - 1]["seq"]
        sessions.append(session)
        window = [x for k, x in enumerate(rows[: i + 1]) if sessions[k] == session and x["ts"] >= r["ts"] - 600]
        speeds = [x["speed"] for x in window if x["speed"] >= 5 and not x["suspect"]]
        run = []
        for x in window:
            run = [] if x["on"] else run + ([] if x["suspect"] else [x])
        moved = None
        if not r["on"] and not r["suspect"] and len(run) >= 6:
            lat, lon = (sorted(x[c] for x in run[:3])[1] for c in ("lat", "lon"))
            metres = lambda a, b: float(anomaly._metres(*(np.float64(v) for v in (*a, *b))))
            new = [(x["lat"], x["lon"]) for x in run[-3:]]
            far = metres((lat, lon), (r["lat"], r["lon"]))
            if far > 500 and all(metres((lat, lon), p) > 250 for p in new) and all(metres(a, b) <= 500 for a, b in zip(new, new[1:], strict=False)):
                moved = far
        out.append((moved, sum(speeds) / len(speeds) if len(speeds) >= 5 else None))
    return out


def test_movement_in_pieces_of_any_size():
    rng, told = random.Random(12), 0
    for _ in range(300):
        ts, seq, lat, on, rows = 0.0, 0, 12.9, False, []
        for _ in range(rng.randint(1, 60)):
            ts += rng.choice([0, 5, 20, 60, 60, 300])
            seq = seq + 1 if rng.random() < 0.95 else 0
            on = rng.random() < 0.3 if rng.random() < 0.1 else on
            lat += rng.choice([0, 0, 0.002, 0.002, 0.01])
            rows.append({"ts": ts, "seq": seq, "lat": lat, "lon": 77.5, "speed": rng.choice([0.0, 4.9, 5.0, 30.1, 30.1]), "on": on, "suspect": rng.random() < 0.1})
        state, got, at = anomaly.Movement(), [], 0
        while at < len(rows):
            part = rows[at : at + rng.randint(1, 20)]
            found = {i: (m, v) for i, m, v in zip(*state.take(*(np.array([r[k] for r in part]) for k in ("seq", "ts", "lat", "lon", "speed", "on", "suspect"))), strict=True)}
            got += [found.get(i, (np.nan, np.nan)) for i in range(len(part))]
            at += len(part)
        want = carried_and_driven(rows)
        told += sum(m is not None for m, _ in want)
        assert np.allclose(np.array(got, dtype=float), np.array(want, dtype=float), rtol=1e-12, equal_nan=True)
    assert told > 50
