"""Rules of the fleet operators on small inputs, most restated in plain Python."""

from __future__ import annotations

import heapq
import hmac
import math
import random

import pytest
from pyspark.sql import functions as F

from fleetglass.functions import geo, privacy
from fleetglass.operators import anomaly, clean, convoy, fence, normalise, risk, route
from fleetglass.operators.components import components
from fleetglass.operators.numbering import numbered
from fleetglass.plans import jobs, monitor, partners, serve
from fleetglass.schema import EVENT, SLOW_CONVOY
from fleetglass.sources import raw as sources

NOON = 1704067200.0 + 6.5 * 3600
LAT, LON = 12.9716, 77.5946
LOANS = "vehicle_id string, loan_id long, lender_id long, days_past_due int, status string"


def event(seq, ts=None, vehicle="VH-000001", **changes):
    at = NOON + 20 * seq if ts is None else ts
    row = {"event_id": f"{vehicle}-{seq}-{at}", "vehicle_id": vehicle, "oem": "A", "seq": seq, "device_ts": float(at), "ingest_ts": float(at + 1), "lat": LAT, "lon": LON, "geohash": "", "speed_kmh": 0.0, "heading_deg": 0.0, "ignition": True, "battery_v": 4.1, "odometer_km": 1.0, "flags": []}
    return row | changes


def frame(spark, rows, extra=""):
    names = [x.split(" ")[0] for x in (EVENT + extra).split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], EVENT + extra)
    return df.withColumn("geohash", geo.geohash(F.col("lat"), F.col("lon"), 7))


def arrivals(spark, rows):
    return frame(spark, [r | {"offset": i} for i, r in enumerate(rows)], ", offset long")


def bisected(lat, lon, precision):
    lo, hi, out, value = [-90.0, -180.0], [90.0, 180.0], "", 0
    for bit in range(precision * 5):
        k, x = (0, lat) if bit % 2 else (1, lon)
        mid = (lo[k] + hi[k]) / 2
        value = value * 2 + (x >= mid)
        (lo if x >= mid else hi)[k] = mid
        if bit % 5 == 4:
            out, value = out + geo.BASE32[value], 0
    return out, (lo[0], hi[0], lo[1], hi[1])


# ---------------------------------------------------------------- normalisation
#: One moment, 2025-06-01 06:30:15.25 UTC, told by each kind of device.
AT = 1748759415.25
GOOD = {
    "B": b"B|VH-700815|1748759415250|48.85661|2.35222|24.8548|0|31|372.5|3950|100",
    "A": b'{"vehicle_id":"VH-700815","seq":31,"timestamp":"2025-06-01T06:30:15.250Z","lat":48.85661,"lon":2.35222,"speed_kmh":40,"heading_deg":12.5,"ignition":false,"battery_v":3.95,"odometer_km":160.9344}',
    "C": b'{"dev":{"id":"VH-700815","seq":31},"time":{"local":"2025-06-01T08:30:15.250","offset":"+02:00"},"gps":{"lat_e6":48856610,"lon_e6":2352220,"hdg":12.5},"motion":{"spd_ms":11.11111},"status":"0x40","power":{"batt_mv":3950},"odo_m":160934}',
}


def changed(oem: str, old: bytes, new: bytes) -> bytes:
    assert old in GOOD[oem]
    return GOOD[oem].replace(old, new)


#: Each rule of the three formats broken once, by reason.
BAD = [
    (b"", "unknown_format"), (b"{}", "unknown_format"), (b" [1]", "unknown_format"), (b"B|\xc3\x28", "bad_encoding"), (GOOD["C"][:-1], "bad_json"), (changed("A", b'"lat":48.85661', b'"lat":48.85661,"lat":1'), "bad_json"),
    (changed("B", b"|31|", b"|3.1|"), "b_bad_values"), (changed("B", b"VH-700815", b"VH-70081"), "b_bad_values"), (GOOD["B"] + b"|1", "b_bad_fields"),
    (changed("A", b'"lon":2.35222,', b""), "missing_lon"), (changed("A", b"false", b"0"), "bad_type_ignition"), (changed("A", b"VH-700815", b"vh-700815"), "bad_vehicle_id"), (changed("A", b":31,", b":-31,"), "bad_seq"),
    (changed("A", b'"speed_kmh":40', b'"speed_kmh":-0.5'), "speed_out_of_range"), (changed("A", b"2.35222", b"-180.5"), "gps_out_of_range"), (changed("A", b"-06-01T", b"-06-31T"), "a_bad_timestamp"),
    (changed("C", b"0x40", b"40"), "c_bad_status_hex"), (changed("C", b"+02:00", b"Z"), "c_bad_time"), (changed("C", b'"seq":31', b'"seq":31.5'), "bad_type_seq"), (changed("C", b'"power"', b'"powers"'), "missing_power"), (changed("C", b"160934", b"null"), "bad_type_odo_m"),
]


def test_normalise(spark):
    rows = [(p, NOON, i) for i, p in enumerate([*GOOD.values(), *[b for b, _ in BAD]])]
    out = normalise.normalise(spark.createDataFrame(rows, "payload binary, ingest_ts double, offset long")).orderBy("offset").collect()
    for r, oem in zip(out, GOOD, strict=False):
        e = r["event"]
        assert (r["reason"], r["format"], e["oem"], e["vehicle_id"], e["seq"], e["ignition"]) == (None, oem, oem, "VH-700815", 31, False)
        assert e["device_ts"] == pytest.approx(AT)
        assert (e["lat"], e["lon"], e["heading_deg"], e["battery_v"]) == (48.85661, 2.35222, 12.5, 3.95)
        assert e["speed_kmh"] == pytest.approx(40.0, abs=1e-3)
        assert e["odometer_km"] == pytest.approx(160.9344, abs=1e-3)
        assert e["geohash"] == bisected(48.85661, 2.35222, 7)[0]
    assert len({r["event"]["event_id"] for r in out[:3]}) == 1
    assert [r["reason"] for r in out[3:]] == [reason for _, reason in BAD]


def test_dead_letters_replace_bad_bytes(spark):
    raw = spark.createDataFrame([(b"\xffabc", NOON, 0)], "payload binary, ingest_ts double, offset long")
    letter = normalise.dead_letters(normalise.normalise(raw)).first()["letter"]
    assert "bad_encoding" in letter
    assert "�abc" in letter


# ---------------------------------------------------------------- cleaning
def test_dedup_slots_renew(spark):
    times = [0, 300, 900, 1500, 2800]
    rows = [event(1, NOON, event_id="x", ingest_ts=1704067200.0 + t) for t in times]
    kept = clean.dedup_by_slots(arrivals(spark, rows)).collect()
    assert sorted(r["ingest_ts"] - 1704067200.0 for r in kept) == [0, 2800]


def test_reorder_rules(spark):
    seqs = [1, 3, 2, 4, 6, 7]
    rows = [event(s, ingest_ts=NOON + 500 + i) for i, s in enumerate(seqs)] + [event(20, ingest_ts=NOON + 600), event(5, ingest_ts=NOON + 601)]
    out = clean.reorder(arrivals(spark, rows)).orderBy("position").collect()
    assert [(r["seq"], r["outcome"]) for r in out] == [(1, "normal"), (2, "normal"), (3, "normal"), (4, "normal"), (6, "normal"), (7, "normal"), (5, "late"), (20, "normal")]


def test_reorder_restart_and_hold(spark):
    old = [event(s, ingest_ts=NOON + s) for s in (60, 62)]
    new = [event(1, NOON - 9000, ingest_ts=NOON + 70), event(2, NOON - 8980, ingest_ts=NOON + 71)]
    out = clean.reorder(arrivals(spark, old + new)).orderBy("position").collect()
    assert [r["seq"] for r in out] == [60, 62, 1, 2]
    held = [event(5, ingest_ts=NOON), event(7, ingest_ts=NOON + 200)]
    assert [r["seq"] for r in clean.reorder(arrivals(spark, held)).orderBy("position").collect()] == [5, 7]


def test_noise(spark):
    rows = [event(1), event(2, lat=LAT + 0.00005), event(3, lat=LAT + 0.05), event(4, lat=LAT + 0.0001, speed_kmh=5.0)]
    out = clean.flag_noise(frame(spark, rows)).orderBy("seq").collect()
    assert [r["flags"] for r in out] == [[], [], ["suspect_gps"], []]
    assert out[1]["lat"] == LAT
    assert out[1]["geohash"] == out[0]["geohash"]


def test_chaos_keeps_every_event_once_and_in_order(spark):
    rng, rows = random.Random(4), []
    for v in range(6):
        for s in range(1, 41):
            sent = NOON + 20 * s + rng.choice([0, 1, 30, 90])
            for copy in range(rng.choice([1, 1, 2, 3])):
                rows.append(event(s, vehicle=f"VH-00000{v}", event_id=f"{v}-{s}", ingest_ts=sent + copy))
    rows.sort(key=lambda r: r["ingest_ts"])
    out = clean.reorder(clean.dedup_by_slots(arrivals(spark, rows))).collect()
    assert len(out) == len({r["event_id"] for r in out}) == 240
    for v in range(6):
        own = sorted((r for r in out if r["vehicle_id"] == f"VH-00000{v}" and r["outcome"] == "normal"), key=lambda r: r["position"])
        assert [r["device_ts"] for r in own] == sorted(r["device_ts"] for r in own)


def in_order(rows):
    """The rules of ordering for one vehicle, row by row with a plain list."""
    out, waiting = [], []
    newest = last = -math.inf
    number, top = 0, -1

    def let_go(now):
        nonlocal last, number
        while waiting and (waiting[0]["device_ts"] <= newest - 120 or waiting[0]["seq"] == number + 1 or now - waiting[0]["ingest_ts"] >= 130):
            r = waiting.pop(0)
            last, number = r["device_ts"], r["seq"]
            out.append((r["seq"], r["device_ts"], "normal"))

    for r in rows:
        let_go(r["ingest_ts"])
        if r["seq"] <= 5 and top - r["seq"] >= 50:
            out += [(w["seq"], w["device_ts"], "normal") for w in waiting]
            waiting.clear()
            newest = last = -math.inf
            number, top = 0, -1
        if r["device_ts"] < last or r["device_ts"] < newest - 120:
            out.append((r["seq"], r["device_ts"], "late"))
            continue
        waiting.append(r)
        waiting.sort(key=lambda w: (w["device_ts"], w["seq"], w["ingest_ts"]))
        newest, top = max(newest, r["device_ts"]), max(top, r["seq"])
        let_go(r["ingest_ts"])
    return out + [(w["seq"], w["device_ts"], "normal") for w in waiting]


def test_order_of_random_arrivals_in_small_batches(spark):
    rng, rows = random.Random(11), []
    for v in range(5):
        start = 0
        for s in range(1, 160):
            if s == 100 and v % 2:
                start = 99
            if rng.random() < 0.9:
                at = NOON + 20 * s
                rows.append(event(s - start, at, vehicle=f"VH-00000{v}", ingest_ts=at + rng.choice([0, 0, 0, 1, 25, 45, 90, 200]) + rng.random()))
    rows.sort(key=lambda r: r["ingest_ts"])
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        out = clean.reorder(arrivals(spark, rows)).orderBy("position").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for v in range(5):
        name = f"VH-00000{v}"
        assert [(r["seq"], r["device_ts"], r["outcome"]) for r in out if r["vehicle_id"] == name] == in_order([r for r in rows if r["vehicle_id"] == name])


def test_noise_of_random_walks_in_small_batches(spark):
    rng, rows, want = random.Random(13), [], {}
    for v in range(4):
        lat, fix = LAT, None
        for s in range(150):
            stopped = s // 12 % 3 == 0
            lat += 0 if stopped else rng.choice([0.0002, 0.002])
            r = event(s, NOON + 20 * s * (1 if s % 17 else 0.99), vehicle=f"VH-00000{v}", lat=lat + rng.choice([0, 0.00004, 0.00009, 0.0002] if stopped else [0]) + rng.choice([0] * 8 + [0.05]), speed_kmh=0.4 if stopped else 40.0)
            rows.append(r)
    for v in range(4):
        fix = None
        for r in sorted((r for r in rows if r["vehicle_id"] == f"VH-00000{v}"), key=lambda r: (r["device_ts"], r["seq"])):
            at = r["lat"]
            if fix:
                metres, s = 6_371_000.0 * math.radians(abs(at - fix[0])), r["device_ts"] - fix[1]
                if s > 0 and metres / s * 3.6 > 250:
                    want[r["vehicle_id"], r["seq"]] = (at, True)
                    continue
                at = fix[0] if r["speed_kmh"] < 1 and metres < 15 else at
            fix = (at, r["device_ts"])
            want[r["vehicle_id"], r["seq"]] = (at, False)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "29")
    try:
        got = {(r["vehicle_id"], r["seq"]): (r["lat"], r["flags"] == ["suspect_gps"]) for r in clean.flag_noise(frame(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == want
    assert any(s for _, s in want.values())


# ---------------------------------------------------------------- geography
def test_geohash_and_neighbours(spark):
    rng = random.Random(2)
    points = [(rng.uniform(-89, 89), rng.uniform(-179, 179)) for _ in range(200)] + [(LAT, LON), (0.0, 0.0)]
    df = spark.createDataFrame(points, "lat double, lon double").withColumn("g", geo.geohash(F.col("lat"), F.col("lon"), 6))
    out = df.select("lat", "lon", "g", geo.geohash_box(F.col("g"), 6).alias("b"), geo.neighbours(F.col("g"), 6).alias("n")).collect()
    for r in out:
        cell, box = bisected(r["lat"], r["lon"], 6)
        assert (r["g"], tuple(r["b"])) == (cell, box)
        h, w = box[1] - box[0], box[3] - box[2]
        around = [bisected((box[0] + box[1]) / 2 + i * h, (box[2] + box[3]) / 2 + j * w, 6)[0] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
        assert r["n"] == around


def test_ring_tests(spark):
    df = spark.range(1).select(geo.circle(LAT, LON, 6000.0).alias("ring")).crossJoin(spark.createDataFrame([(LAT + i * 0.01, LON + j * 0.01) for i in range(-8, 9) for j in range(-8, 9)], "lat double, lon double"))
    out = df.select("lat", "lon", geo.in_ring(F.col("lat"), F.col("lon"), F.col("ring")).alias("inside"), geo.haversine_m(LAT, LON, F.col("lat"), F.col("lon")).alias("d")).collect()
    assert all(r["inside"] for r in out if r["d"] < 5900)
    assert not any(r["inside"] for r in out if r["d"] > 6050)
    again = spark.range(1).select(geo.ring_from_geojson(geo.ring_to_geojson(geo.circle(LAT, LON, 6000.0))).alias("a"), geo.circle(LAT, LON, 6000.0).alias("b")).first()
    assert again["a"] == again["b"]


def test_fence_index_equals_exact_test_and_exits(spark):
    fences = spark.range(1).select(F.lit(1).cast("long").alias("geofence_id"), geo.circle(LAT, LON, 6000.0).alias("ring"))
    own = spark.createDataFrame([("VH-000001", 1)], "vehicle_id string, geofence_id long")
    grid = frame(spark, [event(i * 21 + j, lat=LAT + (i - 10) * 0.0063, lon=LON + (j - 10) * 0.0063) for i in range(21) for j in range(21)])
    placed = fence.contained(grid, own, fences).join(fences, "geofence_id")
    assert placed.where(F.col("inside") != geo.in_ring(F.col("lat"), F.col("lon"), F.col("ring"))).count() == 0
    path = [0, 0.1, 0.1, 0, 0.1, 0.1, 0.1, 0.1, 0, 0.1, 0.1, 0.1]
    rows = [event(i, lat=LAT + d) for i, d in enumerate(path)]
    rows[10]["flags"] = ["suspect_gps"]
    out = fence.exits(frame(spark, rows), own, fences).collect()
    assert [r["ts"] for r in out] == [NOON + 20 * 6]


# ---------------------------------------------------------------- anomalies
def test_tow(spark):
    parked = [event(i, ignition=False) for i in range(10)]
    towed = [event(10 + i, ignition=False, lat=LAT + 0.002 * (i + 1), speed_kmh=30.0) for i in range(8)]
    out = anomaly.tows(anomaly.movement(frame(spark, parked + towed))).orderBy("ts").collect()
    assert out[0]["ts"] == NOON + 20 * 13
    assert out[-1]["strength"] == 1.0
    driven = [r | {"ignition": True} for r in towed]
    assert anomaly.tows(anomaly.movement(frame(spark, parked + driven))).count() == 0


def test_night_and_baseline(spark):
    rows = [event(1, 1704067200.0 - 19_800 + 2 * 3600, speed_kmh=40.0), event(2, 1704067200.0 - 19_800 + 12 * 3600, speed_kmh=40.0), event(3, 1704067200.0 - 19_800 + 3 * 3600, speed_kmh=2.0)]
    none = spark.createDataFrame([], "vehicle_id string, active_from int, active_to int")
    assert [r["detail"]["local_hour"] for r in anomaly.night_moves(frame(spark, rows), none).collect()] == ["2"]
    usual = spark.createDataFrame([("VH-000001", 1, 4)], none.schema)
    assert anomaly.night_moves(frame(spark, rows), usual).count() == 0


def test_tamper(spark):
    rows = [event(1), event(2, battery_v=3.7), event(3, NOON + 2000), event(4, NOON + 2020, flags=["suspect_gps"]), event(1, NOON + 5000, vehicle="VH-000002")]
    out = sorted((r["ts"], r["fired_ts"]) for r in anomaly.tampers(frame(spark, rows)).collect())
    assert out == [(NOON + 40, NOON + 940), (NOON + 2020, NOON + 2920)]


def test_session_reset_clears_the_window(spark):
    rows = [event(5, NOON), event(6, NOON + 20), event(1, NOON + 40)]
    out = anomaly.with_window(frame(spark, rows)).orderBy("device_ts").collect()
    assert [len(r["recent"]) for r in out] == [1, 2, 1]


# ---------------------------------------------------------------- routes
def grid(spark, n=6):
    nodes = [(y * n + x, 12.95 + y * 0.001, 77.58 + x * 0.001) for y in range(n) for x in range(n)]
    edges = [(y * n + x, (y + b) * n + x + a, 110.0, [20.0, 40.0, 60.0][((y * n + x) * 7 + ((y + b) * n + x + a) * 3) % 3]) for y in range(n) for x in range(n) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1)) if 0 <= x + a < n and 0 <= y + b < n]
    return nodes, edges


def fastest(edges, src):
    near, cost, heap = {}, {src: 0.0}, [(0.0, src)]
    for u, v, m, kmh in edges:
        near.setdefault(u, []).append((v, m / (kmh * 0.6 / 3.6)))
    while heap:
        d, u = heapq.heappop(heap)
        for v, t in near.get(u, ()):
            if d + t < cost.get(v, math.inf):
                cost[v] = d + t
                heapq.heappush(heap, (d + t, v))
    return cost


def test_shortest_paths(spark):
    nodes, edges = grid(spark)
    n = spark.createDataFrame(nodes, "node_id int, lat double, lon double")
    e = spark.createDataFrame([*edges, (0, 1, 500.0, 60.0)], "u int, v int, len_m double, speed_kmh double")
    roads, speeds = route.road_edges(e), route.fastest_mps(e)
    pairs = [(0, 35), (0, 0), (5, 30), (35, 2)]
    out = route.path_lengths(route.shortest_paths(spark.createDataFrame(pairs, "src int, dst int"), n, roads, speeds), roads).collect()
    assert len(out) == len(pairs)
    for r in out:
        assert r["cost"] == pytest.approx(fastest(edges, r["src"])[r["dst"]])
        assert r["path"][0] == r["src"]
        assert r["path"][-1] == r["dst"]
        assert r["length_m"] == pytest.approx(110.0 * (len(r["path"]) - 1))
    points = spark.createDataFrame([("p", 12.9531, 77.5822), ("far", 13.9, 78.9)], "point_id string, lat double, lon double")
    near = {r["point_id"]: r["node_id"] for r in route.nearest_nodes(points, n).collect()}
    assert near == {"p": 3 * 6 + 2, "far": 35}


def test_nearest_targets_come_from_one_search_for_each_group(spark):
    nodes, edges = grid(spark)
    roads = route.road_edges(spark.createDataFrame([*edges, (98, 99, 5.0, 20.0)], "u int, v int, len_m double, speed_kmh double"))
    targets = [(1, 0), (1, 35), (1, 14), (2, 5), (2, 5), (3, 99)]
    sources = [(s, g) for s in range(0, 36, 5) for g in (1, 2, 3, 4)] + [(98, 3), (0, 1), (98, 1)]
    out = route.nearest_target(spark.createDataFrame(sources, "src int, grp int"), spark.createDataFrame(targets, "grp int, dst int"), roads).collect()
    seconds = {(u, v): m / (kmh * 0.6 / 3.6) for u, v, m, kmh in [*edges, (98, 99, 5.0, 20.0)]}
    want = {}
    for src, grp in set(sources):
        costs = fastest([*edges, (98, 99, 5.0, 20.0)], src)
        reached = [costs[d] for g, d in targets if g == grp and d in costs]
        if reached:
            want[src, grp] = min(reached)
    assert {(r["src"], r["grp"]) for r in out} == set(want)
    assert len(out) == len(want)
    for r in out:
        assert r["cost"] == pytest.approx(want[r["src"], r["grp"]])
        assert (r["path"][0], r["path"][-1]) == (r["src"], r["dst"])
        assert sum(seconds[leg] for leg in zip(r["path"], r["path"][1:])) == pytest.approx(r["cost"])


def test_deviation_needs_a_lasting_absence(spark):
    paths = spark.createDataFrame([("VH-000001", 1, [(LAT, LON)])], "vehicle_id string, trip long, points array<struct<lat:double,lon:double>>")
    far = [event(i, lat=LAT + (0.03 if i >= 3 and i != 10 else 0)) for i in range(40)]
    out = route.deviations(frame(spark, far), paths).collect()
    assert [(r["ts"], r["detail"]["off_path_s"]) for r in out] == [(NOON + 20 * 26, "300")]


# ---------------------------------------------------------------- convoys and components
def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    root = list(range(200))
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {x: root[x] for a, b in edges if a != b for x in (a, b)}


def test_convoy_streaks_and_groups(spark):
    rows = []
    for run in range(9):
        at = NOON - NOON % 300 + 300 * run + 10
        for v, north in enumerate([0, 40, 80, 5000]):
            if not (v == 1 and run == 3):
                rows.append(event(run, at, vehicle=f"VH-00000{v}", lat=LAT + run * 0.003 + north / 111_320, speed_kmh=40.0))
    events = frame(spark, rows)
    states = convoy.snapshots(events)
    alive = convoy.edges_alive(convoy.near_pairs(states), convoy.runs(states))
    streaks = {(r["a"][-1], r["b"][-1], r["run"]): r["streak"] for r in alive.collect()}
    assert streaks["0", "2", 9] == 9
    assert (streaks["0", "1", 4], streaks["0", "1", 9]) == (3, 8)
    assert {(r["run"], ",".join(x[-1] for x in r["members"])) for r in convoy.convoy_groups(alive).collect()} == {(7, "0,1,2"), (8, "0,1,2"), (9, "0,1,2")}
    assert [r["members"] for r in convoy.slow_convoys(events, SLOW_CONVOY).collect()] == [["VH-000000", "VH-000001", "VH-000002"]]


# ---------------------------------------------------------------- risk
def signal(code, ts, vehicle="VH-000001", strength=1.0):
    return (vehicle, code, float(ts), LAT, LON, strength, {})


def test_risk(spark):
    schema = "vehicle_id string, code string, ts double, lat double, lon double, strength double, detail map<string,string>"
    rows = [signal("TOW_SUSPECTED", NOON), signal("GEOFENCE_EXIT", NOON + 60), signal("TOW_SUSPECTED", NOON + 600), signal("TOW_SUSPECTED", NOON + 1900), signal("TOW_SUSPECTED", NOON, "VH-000002", 0.5)]
    loans = spark.createDataFrame([("VH-000001", 7, 1, 90, "default"), ("VH-000002", 8, 1, 0, "current")], LOANS)
    out = risk.decide(spark.createDataFrame(rows, schema), loans).orderBy("vehicle_id", "ts").collect()
    assert [(r["score"], r["write_alert"], r["open_case"]) for r in out][:4] == [(60.0, True, False), (100.0, True, True), (100.0, False, False), (100.0, True, False)]
    assert out[4]["score"] == 15.0
    decided = risk.decide(spark.createDataFrame(rows, schema), loans)
    assert risk.cases(decided, loans).count() == 1
    now = {r["vehicle_id"]: r["score"] for r in risk.rescore(risk.active_signals(decided), loans, NOON + 43_200).collect()}
    assert now["VH-000002"] == 7.5
    assert risk.rescore(risk.active_signals(decided), loans, NOON + 200_000).count() == 0
    known = risk.decide(spark.createDataFrame(rows, schema), loans, spark.createDataFrame([("VH-000001",)], "vehicle_id string"))
    assert known.where("open_case").count() == 0


def test_risk_of_random_signals_row_by_row(spark):
    from fleetglass.schema import WEIGHTS

    rng, want, rows = random.Random(21), [], []
    for v in range(4):
        at = NOON
        for _ in range(60):
            at += rng.choice([30, 400, 1800, 30_000])
            rows.append(signal(rng.choice([*WEIGHTS, "OTHER"]), at, f"VH-00000{v}", rng.choice([1.0, 0.3, 0.7])))
    for v in range(4):
        standing, alerted, case = {}, {}, False
        for _, code, ts, _, _, strength, _ in (r for r in rows if r[0] == f"VH-00000{v}"):
            left = standing[code][0] * max(0, 1 - (ts - standing[code][1]) / 86_400) if code in standing else 0
            if strength >= left:
                standing[code] = (strength, ts)
            score = min(100, sum(WEIGHTS.get(c, 0) * s * max(0, 1 - (ts - t) / 86_400) for c, (s, t) in standing.items()) * (1 + 30 * v / 90))
            alert = ts - alerted.get(code, -1e18) >= 1800
            alerted[code] = ts if alert else alerted[code]
            opens = score > 70 and not case
            case |= opens
            want.append((f"VH-00000{v}", ts, code, pytest.approx(score, abs=0.006), alert, opens))
    loans = spark.createDataFrame([(f"VH-00000{v}", v, 1, 30 * v, "current") for v in range(4)], LOANS)
    schema = "vehicle_id string, code string, ts double, lat double, lon double, strength double, detail map<string,string>"
    out = risk.decide(spark.createDataFrame(rows, schema), loans).orderBy("vehicle_id", "ts").collect()
    assert [(r["vehicle_id"], r["ts"], r["code"], r["score"], r["write_alert"], r["open_case"]) for r in out] == want


def test_missed_alerts_are_greedy(spark):
    rows = [("VH-1", "X", float(t), LAT, LON, 50.0, float(t), True) for t in (0, 1000, 2500, 5000)]
    replayed = spark.createDataFrame(rows, "vehicle_id string, code string, ts double, lat double, lon double, score double, fired_ts double, write_alert boolean")
    stored = spark.createDataFrame([("VH-1", "X", 1700.0)], "vehicle_id string, code string, ts double")
    assert [r["ts"] for r in jobs.missed_alerts(replayed, stored).collect()] == [5000.0]


# ---------------------------------------------------------------- privacy, monitoring, serving
def test_pseudonym_is_hmac(spark):
    key = hmac.new(b"secret", b"partner:p", "sha256").digest()
    got = spark.range(1).select(privacy.pseudonym(privacy.partner_key("secret", "p"), F.lit("VH-000042")).alias("x")).first()["x"]
    assert got == hmac.new(key, b"VH-000042", "sha256").hexdigest()[:16]
    long = spark.range(1).select(privacy.hmac_sha256(b"k" * 100, F.lit(b"m")).alias("x")).first()["x"]
    assert long == hmac.new(b"k" * 100, b"m", "sha256").hexdigest()


def test_k_anonymity(spark):
    rows = [("tdr1v9q", 10.0, 60.0)] * 12 + [("tdr4v9q", 0.0, 0.0)] * 3
    out = partners.cell_insights(spark.createDataFrame(rows, "geohash string, speed_kmh double, score double")).collect()
    assert [tuple(r) for r in out] == [("tdr1v", 12, 1.0, 10.0, 1.0)]


def test_latency_percentiles_are_exclusive(spark):
    import statistics

    values = [random.Random(1).uniform(0, 100) for _ in range(57)]
    cuts = statistics.quantiles(values, n=100)
    out = monitor.latency_percentiles(spark.createDataFrame([(v,) for v in values], "x double"), "x").first()
    assert tuple(out) == tuple(pytest.approx(cuts[q - 1], abs=0.051) for q in (50, 90, 99))


def test_numbering(spark):
    out = numbered(spark.range(100).withColumn("x", 1000 - F.col("id")), "x").collect()
    assert all(r["row_no"] == 100 - r["id"] for r in out)


def test_numbering_of_a_wide_table_of_many_rows(spark):
    wide = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("x"), F.sha2(F.col("id").cast("string"), 256).alias("wide"), F.lit(1).alias("_part"))
    out = numbered(wide, "x")
    assert out.columns == ["x", "wide", "_part", "row_no"]
    facts = out.agg(F.count("*"), F.count_distinct("row_no"), F.min("row_no"), F.max("row_no")).first()
    assert tuple(facts) == (1_000_000, 1_000_000, 1, 1_000_000)
    assert out.where((F.col("x") == 0) & (F.col("row_no") != 1)).count() == 0


def test_trail_joins_history_and_hot_rows(spark):
    events = frame(spark, [event(i) for i in range(10)])
    out = serve.trail(events, jobs.export_rows(events), "VH-000001", NOON, NOON + 1000, NOON + 30 * 86_400 + 100)
    assert [r["seq"] for r in out.collect()] == list(range(10))
    with pytest.raises(ValueError, match="seven"):
        serve.trail(events, events, "VH-000001", NOON, NOON + 8 * 86_400, NOON)


def test_export_replaces_only_its_days(spark, tmp_path):
    root = str(tmp_path / "h")
    events = frame(spark, [event(1), event(2, NOON + 86_400)])
    jobs.export(events, root)
    jobs.export(frame(spark, [event(3)]), root)
    assert sorted(r["seq"] for r in spark.read.parquet(root).collect()) == [2, 3]
    assert sources.read_days(spark, root, ["2024-01-02"]).count() == 1
