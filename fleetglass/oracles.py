"""DuckDB SQL for the registered queries, written on its own from the same derived tables."""

from __future__ import annotations

import hashlib
import hmac
import math

from .fixtures import with_clause
from .functions.geo import BASE32
from .queries import CENTRE, DAY, NOW, PARTNER, SECRET
from .schema import CONVOY, MOVING_KMH, SLOW_CONVOY, TRAFFIC, WEIGHTS

_ORACLES: dict[str, str] = {}


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _put(name: str, tables: tuple[str, ...], body: str, *more: str, recursive: bool = False) -> None:
    parts = [*([with_clause(*tables)] if tables else []), *more]
    _ORACLES[name] = (f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(parts) + "\n" if parts else "") + body


def _geohash(lat: str, lon: str, precision: int) -> str:
    of_lon, of_lat = (5 * precision + 1) // 2, 5 * precision // 2
    x = f"least(floor(({lon} + 180) / 360 * {1 << of_lon}), {(1 << of_lon) - 1})::BIGINT"
    y = f"least(floor(({lat} + 90) / 180 * {1 << of_lat}), {(1 << of_lat) - 1})::BIGINT"
    chars = []
    for c in range(precision):
        bits = [f"((({y}) >> {of_lat - 1 - k // 2}) & 1)" if k % 2 else f"((({x}) >> {of_lon - 1 - k // 2}) & 1)" for k in range(5 * c, 5 * c + 5)]
        chars.append(f"substr('{BASE32}', ({' + '.join(f'{b} * {1 << (4 - i)}' for i, b in enumerate(bits))} + 1)::BIGINT, 1)")
    return " || ".join(chars)


def _haversine(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371000.0::DOUBLE * asin(sqrt(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


_HASHED = f"hashed AS (SELECT *, {_geohash('lat', 'lon', 7)} AS geohash FROM telemetry)"
_LOCAL = "(to_timestamp(device_ts) AT TIME ZONE 'UTC' + INTERVAL 330 MINUTE)"
#: The noise filter step by step; seq counts each vehicle's rows from 1 in order of time.
_NOISE = f"""
fixed(vehicle_id, seq, suspect, lat, lon, flat, flon, fts, cell) AS (
  SELECT vehicle_id, seq, false, lat, lon, lat, lon, device_ts, geohash FROM hashed WHERE seq = 1
  UNION ALL
  SELECT vehicle_id, seq, jump, CASE WHEN snap THEN flat ELSE lat END, CASE WHEN snap THEN flon ELSE lon END,
    CASE WHEN jump OR snap THEN flat ELSE lat END, CASE WHEN jump OR snap THEN flon ELSE lon END, CASE WHEN jump THEN fts ELSE device_ts END, CASE WHEN jump OR snap THEN cell ELSE geohash END
  FROM (SELECT h.vehicle_id, h.seq, h.lat, h.lon, h.device_ts, h.geohash, f.flat, f.flon, f.fts, f.cell,
      moved / (h.device_ts - f.fts) * 3.6 > 250 AS jump, NOT (moved / (h.device_ts - f.fts) * 3.6 > 250) AND h.speed_kmh < 1 AND moved < 15 AS snap
    FROM fixed f JOIN hashed h ON h.vehicle_id = f.vehicle_id AND h.seq = f.seq + 1, LATERAL (SELECT {_haversine('f.flat', 'f.flon', 'h.lat', 'h.lon')} AS moved) AS m) AS judged),
noisy AS (SELECT h.* EXCLUDE (lat, lon, geohash), f.suspect, f.lat, f.lon, CASE WHEN f.suspect THEN h.geohash ELSE f.cell END AS geohash FROM hashed h JOIN fixed f USING (vehicle_id, seq))"""
_PARSED = """
good AS (SELECT *, event_id % 71 = 0 AND (event_id % 4 = 0 OR (event_id % 4 = 1 AND oem = 'B') OR (event_id % 4 = 2 AND oem = 'C') OR (event_id % 4 = 3 AND oem <> 'B')) AS bad FROM payloads),
judged AS (SELECT *, CASE WHEN event_id % 71 = 0 AND event_id % 4 = 1 AND oem = 'B' THEN 'unknown' ELSE oem END AS format,
  CASE WHEN NOT bad THEN NULL WHEN event_id % 4 = 0 THEN CASE WHEN oem = 'B' THEN 'b_bad_fields' ELSE 'bad_json' END WHEN event_id % 4 = 1 THEN 'unknown_format' WHEN event_id % 4 = 2 THEN 'c_bad_status_hex' ELSE 'missing_seq' END AS reason FROM good)"""
_SCORE = f"""
active AS (SELECT vehicle_id, code, max(created_ts) AS ts FROM alert GROUP BY 1, 2),
due AS (SELECT vehicle_id, days_past_due FROM loan WHERE status <> 'closed'),
scores AS (SELECT vehicle_id, round_even(least(100, total * (1 + least(coalesce(days_past_due, 0), 90) / 90.0::DOUBLE)), 2) AS score
  FROM (SELECT vehicle_id, sum(CASE code {' '.join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())} END::DOUBLE * greatest(0, 1 - ({NOW} - ts) / 86400)) AS total FROM active GROUP BY 1) LEFT JOIN due USING (vehicle_id))"""
_BOARD = f"{_SCORE}, board AS (SELECT * FROM scores WHERE score > 0)"
_POSITIONS = "positions AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY device_ts DESC) AS r FROM hashed) WHERE r = 1)"
_RING = ", ".join(f"({k}, {CENTRE[0]} + 6000 * cos({2 * math.pi * k / 32}) / 111320.0, {CENTRE[1]} + 6000 * sin({2 * math.pi * k / 32}) / (111320.0 * cos(radians({CENTRE[0]}::DOUBLE))))" for k in range(32))
_EDGES = f"""
corner(k, lat, lon) AS (SELECT k, lat::DOUBLE, lon::DOUBLE FROM (VALUES {_RING}) AS v(k, lat, lon)),
side AS (SELECT a.lat AS la1, a.lon AS lo1, b.lat AS la2, b.lon AS lo2 FROM corner a JOIN corner b ON b.k = (a.k + 1) % 32)"""
_INSIDE = "(SELECT count(*) % 2 = 1 FROM side WHERE (la1 > lat) <> (la2 > lat) AND lon < lo1 + (lat - la1) * (lo2 - lo1) / (la2 - la1))"
_OWN = "own AS (SELECT vehicle_id, lender_id FROM loan WHERE status <> 'closed')"
_BASE = f"""
hours AS (SELECT *, hour({_LOCAL}) AS h FROM hashed),
home AS (SELECT vehicle_id, geohash, row_number() OVER (PARTITION BY vehicle_id ORDER BY count(*) DESC, geohash) AS r FROM hours WHERE speed_kmh < {MOVING_KMH} AND (h < 6 OR h >= 22) GROUP BY 1, 2),
work AS (SELECT vehicle_id, geohash, row_number() OVER (PARTITION BY vehicle_id ORDER BY count(*) DESC, geohash) AS r FROM hours WHERE speed_kmh < {MOVING_KMH} AND h BETWEEN 10 AND 16 GROUP BY 1, 2),
drive AS (SELECT vehicle_id, quantile_disc(h, 0.05) AS h0, quantile_disc(h, 0.95) AS h1, avg(speed_kmh) AS avg_speed, coalesce(stddev_samp(speed_kmh), 0) AS std_speed FROM hours WHERE speed_kmh >= {MOVING_KMH} GROUP BY 1)"""
_STATES = "states AS (SELECT * FROM (SELECT *, (floor(device_ts / 300) * 300)::BIGINT AS slot, row_number() OVER (PARTITION BY floor(device_ts / 300), vehicle_id ORDER BY device_ts DESC, seq DESC) AS r FROM hashed) WHERE r = 1)"


def _pairs(rules: dict) -> str:
    return f"""pairs AS (SELECT a.slot, a.vehicle_id AS a, b.vehicle_id AS b FROM states a JOIN states b ON a.slot = b.slot AND a.vehicle_id < b.vehicle_id
  WHERE a.speed_kmh >= {rules['moving_kmh']} AND b.speed_kmh >= {rules['moving_kmh']} AND {_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {rules['max_m']}
    AND least(abs(a.heading_deg - b.heading_deg) % 360, 360 - abs(a.heading_deg - b.heading_deg) % 360) <= {rules['max_heading']} AND abs(a.speed_kmh - b.speed_kmh) <= {rules['max_speed']})"""


def _alive(rules: dict) -> str:
    return f"""{_pairs(rules)},
runs AS (SELECT slot, row_number() OVER (ORDER BY slot) AS run FROM (SELECT DISTINCT slot FROM states)),
seen AS (SELECT run, a, b, CASE WHEN run - lag(run) OVER w <= {rules['grace'] + 1} THEN 0 ELSE 1 END AS fresh, lead(run) OVER w AS following FROM pairs JOIN runs USING (slot) WINDOW w AS (PARTITION BY a, b ORDER BY run)),
island AS (SELECT *, sum(fresh) OVER (PARTITION BY a, b ORDER BY run) AS i FROM seen),
streaks AS (SELECT *, row_number() OVER (PARTITION BY a, b, i ORDER BY run) AS streak FROM island),
alive AS (SELECT unnest(range(run, least(coalesce(following - 1, m), run + {rules['grace']}, m) + 1)) AS run, a, b, streak FROM streaks, (SELECT max(run) AS m FROM runs))"""


def _groups(rules: dict) -> str:
    return f"""{_alive(rules)},
lasting AS (SELECT run, a, b FROM alive WHERE streak >= {rules['runs']} UNION SELECT run, b, a FROM alive WHERE streak >= {rules['runs']}),
reach(run, v, w) AS (SELECT run, a, a FROM lasting UNION SELECT r.run, r.v, l.b FROM reach r JOIN lasting l ON l.run = r.run AND l.a = r.w),
groups AS (SELECT DISTINCT run, members FROM (SELECT run, v, list(w ORDER BY w) AS members FROM reach GROUP BY 1, 2) WHERE len(members) >= {rules['size']})"""


_MAXIMAL = "maximal AS (SELECT DISTINCT members FROM groups g WHERE NOT EXISTS (SELECT 1 FROM groups o WHERE len(o.members) > len(g.members) AND list_has_all(o.members, g.members)))"
_INNER_PAD, _OUTER_PAD = (bytes(b ^ x for b in hmac.new(SECRET.encode(), f"partner:{PARTNER}".encode(), hashlib.sha256).digest().ljust(64, b"\0")).hex() for x in (0x36, 0x5C))
_PSEUDONYM = f"substr(sha256(unhex('{_OUTER_PAD}') || unhex(sha256(unhex('{_INNER_PAD}') || encode(vehicle_id)))), 1, 16)"

# sources and sinks
_put("src_split_bodies", (), "SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 0")
_put("src_vehicle_key", ("payloads",), "SELECT arrival AS \"offset\", nullif(regexp_extract(text, 'VH-[0-9]{6}'), '') AS vehicle_key FROM payloads")
_put("src_json_round_trip", ("telemetry",), "SELECT substr(sha1(vehicle_id || '|' || (device_ts * 1000)::BIGINT || '|' || seq), 1, 20) AS event_id, vehicle_id, seq, device_ts, lat, lon, ignition, 0::BIGINT AS n_flags FROM telemetry")
_put("src_store_feed", ("telemetry",), """SELECT substr(sha1(vehicle_id || '|' || (device_ts * 1000)::BIGINT || '|' || seq), 1, 20) AS event_id, strftime(make_timestamp((device_ts * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S.%f') AS device_ts,
  strftime(make_timestamp((ingest_ts * 1000000)::BIGINT), '%Y-%m-%d %H:%M:%S.%f') AS ingest_ts, CASE WHEN late THEN '{late}' ELSE '{}' END AS flags
FROM (SELECT *, coalesce(device_ts < max(device_ts) OVER (PARTITION BY vehicle_id ORDER BY ingest_ts, source_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 120, false) AS late FROM telemetry)""")
_put("src_raw_files", ("payloads",), 'SELECT arrival AS "offset", ingest_ts, strlen(text) AS n_bytes FROM payloads')
_put("src_csv_types", ("telemetry",), "SELECT vehicle_id, seq, device_ts, lpad(seq::VARCHAR, 5, '0') AS flags FROM telemetry")
_put("snk_export_partitions", ("telemetry",), f"SELECT strftime({_LOCAL}, '%Y-%m-%d') AS date, substr(geohash, 1, 2) AS cell, count(*) AS n, count(DISTINCT vehicle_id) AS vehicles FROM hashed WHERE strftime({_LOCAL}, '%Y-%m-%d') = '{DAY}' GROUP BY 1, 2", _HASHED)
_put("snk_new_rows", ("telemetry",), "SELECT substr(sha1(vehicle_id || '|' || (device_ts * 1000)::BIGINT || '|' || seq), 1, 20) AS event_id, vehicle_id, seq FROM telemetry WHERE source_id % 3 <> 0")
_put("snk_retention", ("telemetry",), f"SELECT strftime({_LOCAL}, '%Y-%m-%d') AS date, count(*) AS n FROM hashed WHERE strftime({_LOCAL}, '%Y-%m-%d') >= '2024-01-02' GROUP BY 1", _HASHED)
_put("snk_latest_report", ("loan", "recovery_case"), """SELECT lender_id, date, opened FROM (SELECT *, row_number() OVER (PARTITION BY lender_id ORDER BY date DESC) AS r FROM (
  SELECT lender_id, strftime(to_timestamp(opened_ts) AT TIME ZONE 'UTC' + INTERVAL 330 MINUTE, '%Y-%m-%d') AS date, count(*) AS opened FROM recovery_case JOIN loan USING (loan_id) GROUP BY 1, 2)) WHERE r = 1""")

# normalisation and cleaning
_put("norm_outcomes", ("payloads",), 'SELECT arrival AS "offset", format, reason FROM judged', _PARSED)
_put("norm_events", ("payloads",), f"""SELECT arrival AS "offset", substr(sha1(vehicle_id || '|' || device_s * 1000 || '|' || seq), 1, 20) AS event_id, vehicle_id, oem, seq, {_geohash('lat', 'lon', 7)} AS geohash, ignition,
  device_s::DOUBLE AS device_ts, lat, lon, round_even(speed * CASE oem WHEN 'A' THEN 1 WHEN 'B' THEN 1.609344::DOUBLE ELSE 3.6::DOUBLE END, 6) AS speed_kmh, heading::DOUBLE AS heading_deg,
  CASE WHEN low THEN 3.7 ELSE 4.1 END::DOUBLE AS battery_v, round_even((10000 + seq) * CASE oem WHEN 'B' THEN 1.609344::DOUBLE ELSE 1 END, 6) AS odometer_km
FROM (SELECT *, lat_e6::DOUBLE / 1000000::DOUBLE AS lat, lon_e6::DOUBLE / 1000000::DOUBLE AS lon FROM judged WHERE NOT bad)""", _PARSED)
_put("norm_counters", ("payloads",), """SELECT name, count(*) AS n FROM (SELECT unnest(list_filter(['in', 'in.' || format, CASE WHEN bad THEN 'dead_letter' END, CASE WHEN bad THEN 'dead_letter.' || reason END, CASE WHEN bad THEN 'dead_letter.oem.' || format END,
  CASE WHEN NOT bad THEN 'parsed' END, CASE WHEN NOT bad THEN 'parsed.' || format END], lambda x: x IS NOT NULL)) AS name FROM judged) GROUP BY 1""", _PARSED)
_put("norm_dead_letters", ("payloads",), 'SELECT arrival AS "offset", reason, text AS payload, ingest_ts FROM judged WHERE bad', _PARSED)
_put("norm_samples", ("payloads",), """SELECT arrival AS "offset", format AS oem, substr(text, 1, 400) AS raw, CASE WHEN bad THEN 'dead_letter' ELSE 'parsed' END AS outcome, coalesce(reason, '') AS detail
FROM (SELECT *, row_number() OVER (ORDER BY arrival) AS r FROM judged) WHERE r % 100 = 0""", _PARSED)
_put("clean_dedup_slots", ("payloads",), """SELECT arrival AS "offset", vehicle_id, seq FROM (SELECT *, lag(floor(ingest_ts / 600)) OVER (PARTITION BY event_id ORDER BY ingest_ts, arrival) AS last FROM judged WHERE NOT bad)
WHERE last IS NULL OR last < floor(ingest_ts / 600) - 1""", _PARSED)
_put("clean_first_of_batch", ("payloads",), 'SELECT arrival AS "offset", vehicle_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingest_ts, arrival) AS r FROM judged WHERE NOT bad) WHERE r = 1', _PARSED)
_put("clean_behind_watermark", ("payloads",), """SELECT arrival AS "offset", vehicle_id, seq, coalesce(device_s < max(device_s) OVER (PARTITION BY vehicle_id ORDER BY ingest_ts, arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 120, false) AS late
FROM judged WHERE NOT bad""", _PARSED)
_put("clean_noise", ("telemetry",), "SELECT vehicle_id, seq, suspect, round_even(lat, 6) AS lat, round_even(lon, 6) AS lon, geohash FROM noisy", _HASHED, _NOISE, recursive=True)

# geography and fences
_put("geo_steps", ("telemetry",), f"""SELECT source_id, round_even({_haversine('la', 'lo', 'lat', 'lon')}, 3) AS metres,
  round_even((degrees(atan2(sin(radians(77.7::DOUBLE - lo)) * cos(radians(13.1::DOUBLE)), cos(radians(la)) * sin(radians(13.1::DOUBLE)) - sin(radians(la)) * cos(radians(13.1::DOUBLE)) * cos(radians(77.7::DOUBLE - lo)))) + 360) % 360, 3) AS bearing,
  round_even(sqrt(pow((lon - lo) * 111320.0::DOUBLE * cos(radians(la)), 2) + pow((lat - la) * 110540.0::DOUBLE, 2)), 3) AS flat_m, round_even(lat + 1000 / 111320.0::DOUBLE, 6) AS north, round_even(lon + 500 / (111320.0::DOUBLE * cos(radians(lat))), 6) AS east,
  least(abs(heading_deg - 350) % 360, 360 - abs(heading_deg - 350) % 360) AS turn
FROM (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM telemetry WINDOW w AS (PARTITION BY vehicle_id ORDER BY seq)) WHERE la IS NOT NULL""")
_put("geo_rings", ("loan",), "SELECT lender_id, k::BIGINT AS at, round_even(lat, 6) AS lat, round_even(lon, 6) AS lon FROM (SELECT DISTINCT lender_id FROM loan), corner", _EDGES)
_put("fence_contained", ("telemetry", "loan"), f"SELECT source_id, lender_id AS geofence_id, {_INSIDE} AS inside FROM hashed JOIN own USING (vehicle_id)", _HASHED, _EDGES, _OWN)
_put("fence_exits", ("telemetry", "loan"), f"""SELECT vehicle_id, 'GEOFENCE_EXIT' AS code, device_ts AS ts, lender_id::VARCHAR AS geofence_id FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id, lender_id, island ORDER BY device_ts, seq) AS r FROM (
  SELECT *, sum(inside::INT) OVER (PARTITION BY vehicle_id, lender_id ORDER BY device_ts, seq) AS island FROM (SELECT *, {_INSIDE} AS inside FROM noisy JOIN own USING (vehicle_id) WHERE NOT suspect)) WHERE NOT inside) WHERE r = 3""", _HASHED, _NOISE, _EDGES, _OWN, recursive=True)

# anomalies
_put("anomaly_windows", ("telemetry",), "SELECT source_id, count(*) OVER w AS points, round_even(sum(speed_kmh) OVER w, 6) AS speed_sum FROM telemetry WINDOW w AS (PARTITION BY vehicle_id ORDER BY device_ts RANGE BETWEEN 600 PRECEDING AND CURRENT ROW)")
_put("anomaly_tows", ("telemetry",), f"""SELECT vehicle_id, 'TOW_SUSPECTED' AS code, ts, round_even(least(1.0, moved / 1000), 3) AS strength FROM (
  SELECT *, {_haversine('slat', 'slon', 'lat', 'lon')} AS moved FROM (SELECT vehicle_id, device_ts AS ts, lat, lon, run[-1] AS c, run[-2] AS b, run[-3] AS a, list_sort([run[1].lat, run[2].lat, run[3].lat])[2] AS slat, list_sort([run[1].lon, run[2].lon, run[3].lon])[2] AS slon, run
    FROM (SELECT n.*, list_filter(w, lambda p: NOT p.suspect AND p.ts > coalesce(list_max(list_transform(list_filter(w, lambda q: q.ignition), lambda q: q.ts)), 0)) AS run
      FROM (SELECT *, list({{'ts': device_ts, 'lat': lat, 'lon': lon, 'ignition': ignition, 'suspect': suspect}}) OVER (PARTITION BY vehicle_id ORDER BY device_ts RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) AS w FROM noisy) n WHERE NOT ignition AND NOT suspect) WHERE len(run) >= 6))
WHERE moved > 500 AND {' AND '.join(f"{_haversine('slat', 'slon', f'{p}.lat', f'{p}.lon')} > 250" for p in 'abc')} AND {_haversine('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 500 AND {_haversine('b.lat', 'b.lon', 'c.lat', 'c.lon')} <= 500""", _HASHED, _NOISE, recursive=True)
_put("anomaly_night", ("telemetry",), """SELECT vehicle_id, 'NIGHT_MOVEMENT' AS code, device_ts AS ts, floor(x)::BIGINT::VARCHAR AS local_hour FROM (SELECT *, ((device_ts + 19800) % 86400) / 3600 AS x FROM hashed) LEFT JOIN drive USING (vehicle_id)
WHERE x < 5 AND ignition AND speed_kmh >= 5 AND NOT coalesce(x >= h0 AND x < h1 + 1, false)""", _HASHED, _BASE)
_put("anomaly_speed", ("telemetry",), """SELECT vehicle_id, 'SPEED_SPIKE' AS code, device_ts AS ts FROM (SELECT vehicle_id, device_ts, avg(speed_kmh) FILTER (speed_kmh >= 5) OVER w AS mean, count(*) FILTER (speed_kmh >= 5) OVER w AS n FROM telemetry
  WINDOW w AS (PARTITION BY vehicle_id ORDER BY device_ts RANGE BETWEEN 600 PRECEDING AND CURRENT ROW)) JOIN (SELECT vehicle_id, avg(speed_kmh) AS m, coalesce(stddev_samp(speed_kmh), 0) AS s FROM telemetry WHERE speed_kmh >= 5 GROUP BY 1) USING (vehicle_id)
WHERE n >= 5 AND mean > m + 3 * s""")

# routes and convoys
_put("route_nearest_nodes", ("telemetry",), """SELECT source_id AS point_id, arg_min(node_id, {'d': d, 'n': node_id}) AS node_id FROM (SELECT source_id, node_id, sqrt(pow((n.lon - t.lon) * cos(radians(t.lat)), 2) + pow(n.lat - t.lat, 2)) AS d
  FROM telemetry t, (SELECT k AS node_id, 12.95::DOUBLE + CASE WHEN k < 100 THEN k // 10 ELSE least(k - e * e, e) END * 0.006::DOUBLE AS lat, 77.58::DOUBLE + CASE WHEN k < 100 THEN k % 10 ELSE least(e, 2 * e - (k - e * e)) END * 0.006::DOUBLE AS lon
  FROM (SELECT DISTINCT p_partkey::INT AS k, floor(sqrt(p_partkey))::INT AS e FROM part)) n) GROUP BY 1""")
# the grid's roads, each vehicle's first and last node, and labels that settle until no road makes one cheaper
_ROADS = f"""grid AS (SELECT k AS node_id, CASE WHEN k < 100 THEN k % 10 ELSE least(e, 2 * e - (k - e * e)) END AS x, CASE WHEN k < 100 THEN k // 10 ELSE least(k - e * e, e) END AS y
  FROM (SELECT DISTINCT p_partkey::INT AS k, floor(sqrt(p_partkey))::INT AS e FROM part)),
road AS (SELECT a.node_id AS u, b.node_id AS v, 660.0::DOUBLE / ([20.0, 40.0, 60.0][(a.node_id::BIGINT * 7 + b.node_id::BIGINT * 3) % 3 + 1]::DOUBLE * {TRAFFIC}::DOUBLE / 3.6::DOUBLE) AS travel_s
  FROM grid a JOIN grid b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 AND a.x BETWEEN b.x - 1 AND b.x + 1)"""
_ENDS = """fix AS (SELECT vehicle_id, arg_min({'lat': lat, 'lon': lon}, seq) AS a, arg_max({'lat': lat, 'lon': lon}, seq) AS b FROM telemetry GROUP BY 1),
snapped AS (SELECT vehicle_id, side, arg_min(node_id, {'d': sqrt(pow((77.58::DOUBLE + x * 0.006::DOUBLE - p.lon) * cos(radians(p.lat)), 2) + pow(12.95::DOUBLE + y * 0.006::DOUBLE - p.lat, 2)), 'n': node_id}) AS node_id
  FROM (SELECT vehicle_id, 'a' AS side, a AS p FROM fix UNION ALL SELECT vehicle_id, 'b', b FROM fix), grid GROUP BY 1, 2),
pair AS (SELECT f.vehicle_id, f.node_id AS src, t.node_id AS dst FROM snapped f JOIN snapped t USING (vehicle_id) WHERE f.side = 'a' AND t.side = 'b')"""


def _labels(start: str) -> str:
    """Every round takes the cheapest of a node's own label and its neighbours', until neither their number nor their sum changes."""
    return f"""round(grp, node, cost, now, before) AS (SELECT grp, node, cost, '', '-' FROM ({start}) AS s(grp, node, cost)
  UNION ALL SELECT grp, node, cost, concat(count(*) OVER (), ' ', round(sum(cost) OVER (), 3)), now FROM (
    SELECT grp, node, min(cost) AS cost, any_value(now) AS now FROM (SELECT grp, node, cost, now FROM round WHERE now <> before
      UNION ALL SELECT l.grp, r.v, l.cost + r.travel_s, l.now FROM round l JOIN road r ON r.u = l.node WHERE l.now <> l.before) GROUP BY 1, 2)),
label AS (SELECT grp, node, min(cost) AS cost FROM round GROUP BY 1, 2)"""


for _name in ("route_shortest_paths", "route_label_paths"):
    _put(_name, ("telemetry",), "SELECT vehicle_id, src, dst, round_even(cost, 3) AS cost FROM pair JOIN label ON grp = src AND node = dst", _ROADS, _ENDS, _labels("SELECT DISTINCT src, src, 0.0::DOUBLE FROM pair"), recursive=True)
_put("route_nearest_agent", ("telemetry", "loan", "agent"), "SELECT vehicle_id, round_even(cost, 3) AS cost FROM pair JOIN own USING (vehicle_id) JOIN label ON grp = lender_id AND node = dst", _ROADS, _ENDS, _OWN,
     "ranked AS (SELECT node_id, row_number() OVER (ORDER BY node_id) AS r, count(*) OVER () AS n FROM grid)", _labels("SELECT DISTINCT lender_id, node_id, 0.0::DOUBLE FROM agent JOIN ranked ON r = agent_id * 37 % n + 1"), recursive=True)
_put("route_trips", ("telemetry",), """SELECT vehicle_id, seq, starts, sum(starts::INT) OVER (PARTITION BY vehicle_id ORDER BY device_ts, seq)::BIGINT AS trip FROM (SELECT *, ignition AND NOT coalesce(lag(ignition) OVER (PARTITION BY vehicle_id ORDER BY device_ts, seq), false) AS starts FROM noisy WHERE NOT suspect)""", _HASHED, _NOISE, recursive=True)
_put("convoy_snapshots", ("telemetry",), "SELECT slot, vehicle_id, lat, lon, speed_kmh FROM states", _HASHED, _STATES)
_put("convoy_live", ("telemetry",), "SELECT vehicle_id, device_ts, seq FROM positions WHERE (SELECT max(device_ts) FROM positions) - device_ts <= 120", _HASHED, _POSITIONS)
_put("convoy_pairs", ("telemetry",), "SELECT * FROM pairs", _HASHED, _STATES, _pairs(CONVOY))
_put("convoy_edges", ("telemetry",), "SELECT run, a, b, streak FROM alive", _HASHED, _STATES, _alive(CONVOY))
_put("convoy_groups", ("telemetry",), "SELECT run, array_to_string(members, ',') AS members FROM groups", _HASHED, _STATES, _groups(CONVOY), recursive=True)
_put("convoy_slow", ("telemetry",), "SELECT array_to_string(members, ',') AS members FROM maximal", _HASHED, _STATES, _groups(SLOW_CONVOY), _MAXIMAL, recursive=True)
_put("convoy_signals", ("telemetry",), "SELECT unnest(members) AS vehicle_id, 'CONVOY' AS code, len(members)::VARCHAR AS size FROM maximal WHERE NOT members[1] < 'VH-000050'", _HASHED, _STATES, _groups(SLOW_CONVOY), _MAXIMAL, recursive=True)
for _name in ("convoy_live_signals", "stream_convoys"):
    _put(_name, ("telemetry",), """SELECT v AS vehicle_id, 'CONVOY' AS code, ts, size FROM (SELECT run, unnest(members) AS v, len(members) AS size FROM groups g
  WHERE EXISTS (SELECT 1 FROM (SELECT unnest(g.members) AS m) WHERE NOT EXISTS (SELECT 1 FROM groups o WHERE o.run = g.run - 1 AND list_contains(o.members, m))))
JOIN (SELECT run, max(device_ts) AS ts FROM states JOIN runs USING (slot) GROUP BY 1) USING (run)""", _HASHED, _STATES, _groups(CONVOY), recursive=True)
_put("serve_convoys", ("telemetry", "loan"), "SELECT string_agg(v, ',' ORDER BY v) AS members FROM (SELECT members, unnest(members) AS v FROM maximal) JOIN own ON v = vehicle_id AND lender_id = 1 GROUP BY members", _HASHED, _STATES, _groups(SLOW_CONVOY), _MAXIMAL, _OWN, recursive=True)

# risk
_put("risk_rescore", ("alert", "loan"), "SELECT * FROM board", _BOARD)
_put("risk_breakdown", ("alert", "loan"), f"""SELECT vehicle_id, round_even(1 + least(coalesce(days_past_due, 0), 90) / 90.0::DOUBLE, 2) AS multiplier, code, round_even(CASE code {' '.join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS.items())} END::DOUBLE * 10 * greatest(0::DOUBLE, 86400 - ({NOW} - ts)) / 86400, 0) / 10 AS part
FROM active LEFT JOIN due USING (vehicle_id)""", _SCORE)

# jobs
_put("job_export_rows", ("telemetry",), f"SELECT strftime({_LOCAL}, '%Y-%m-%d') AS date, substr(geohash, 1, 2) AS cell, count(*) AS n FROM hashed GROUP BY 1, 2", _HASHED)
_put("job_missing_days", ("telemetry",), f"SELECT strftime(d, '%Y-%m-%d') AS date FROM (SELECT unnest(range(DATE '2024-01-01', DATE '2024-01-06', INTERVAL 1 DAY)) AS d) WHERE strftime(d, '%Y-%m-%d') NOT IN (SELECT strftime({_LOCAL}, '%Y-%m-%d') FROM hashed WHERE strftime({_LOCAL}, '%Y-%m-%d') < '2024-01-03')", _HASHED)
_put("job_baselines", ("telemetry",), """SELECT v.vehicle_id, home.geohash AS home_cell, work.geohash AS work_cell, h0::BIGINT AS active_from, (h1 + 1)::BIGINT AS active_to, round_even(avg_speed, 6) AS avg_speed, round_even(std_speed, 6) AS std_speed
FROM (SELECT DISTINCT vehicle_id FROM hashed) v LEFT JOIN home ON home.vehicle_id = v.vehicle_id AND home.r = 1 LEFT JOIN work ON work.vehicle_id = v.vehicle_id AND work.r = 1 LEFT JOIN drive ON drive.vehicle_id = v.vehicle_id""", _HASHED, _BASE)
_put("job_raised_scores", ("alert", "loan"), "SELECT vehicle_id, greatest(score, new) AS score FROM board FULL JOIN (SELECT vehicle_id, max(risk_score) AS new FROM alert GROUP BY 1) USING (vehicle_id)", _BOARD)
_START = NOW - 2 * 86_400 - 19_800
_TODAY = f"today AS (SELECT a.*, lender_id, days_past_due FROM alert a JOIN loan USING (vehicle_id) WHERE created_ts >= {_START} AND created_ts < {_START + 86_400})"
_put("job_report_figures", ("alert", "loan", "recovery_case"), f"""SELECT lender_id, vehicles, coalesce(alerts, 0) AS alerts, coalesce(v, 0) AS vehicles_with_alerts, coalesce(opened, 0) AS cases_opened, coalesce(r, 0) AS cases_recovered_30d, coalesce(c, 0) AS cases_closed_30d, CASE WHEN r + c > 0 THEN round_even(r / (r + c), 3) ELSE 0 END::DOUBLE AS recovery_rate_30d
FROM (SELECT lender_id, count(*) FILTER (status <> 'closed') AS vehicles FROM loan GROUP BY 1) LEFT JOIN (SELECT lender_id, count(*) AS alerts, count(DISTINCT vehicle_id) AS v FROM today GROUP BY 1) USING (lender_id)
LEFT JOIN (SELECT lender_id, count(*) FILTER (opened_ts >= {_START} AND opened_ts < {_START + 86_400}) AS opened, count(*) FILTER (rc.status = 'recovered') AS r, count(*) FILTER (rc.status = 'closed') AS c FROM recovery_case rc JOIN loan USING (loan_id) GROUP BY 1) USING (lender_id)""", _TODAY)
_put("job_report_signals", ("alert", "loan"), "SELECT lender_id, code, count(*) AS n FROM today GROUP BY 1, 2", _TODAY)
_put("job_report_at_risk", ("alert", "loan"), "SELECT lender_id, r - 1 AS at, vehicle_id, peak_score, days_past_due FROM (SELECT *, row_number() OVER (PARTITION BY lender_id ORDER BY peak_score DESC, vehicle_id) AS r FROM (SELECT lender_id, vehicle_id, max(risk_score) AS peak_score, max(days_past_due)::BIGINT AS days_past_due FROM today GROUP BY 1, 2)) WHERE r <= 25", _TODAY)

# serving
_put("serve_live_counts", ("telemetry", "loan"), "SELECT lender_id, count(*) FILTER (device_ts >= (SELECT max(device_ts) FROM positions) - 7200) AS live FROM positions JOIN own USING (vehicle_id) GROUP BY 1", _HASHED, _POSITIONS, _OWN)
_put("serve_on_the_map", ("telemetry",), "SELECT vehicle_id, device_ts FROM positions WHERE device_ts > (SELECT max(device_ts) FROM positions) - 40000", _HASHED, _POSITIONS)
_put("serve_in_box", ("telemetry", "alert", "loan"), "SELECT vehicle_id, lat, lon, coalesce(score, 0) AS score FROM positions LEFT JOIN board USING (vehicle_id) WHERE lat BETWEEN 12.97 AND 13.0 AND lon BETWEEN 77.59 AND 77.61 AND device_ts >= (SELECT max(device_ts) FROM positions) - 7200 AND vehicle_id IN (SELECT vehicle_id FROM own WHERE lender_id = 1)", _HASHED, _POSITIONS, _BOARD, _OWN)
_put("serve_owned", ("telemetry", "loan"), "SELECT vehicle_id, device_ts FROM positions WHERE vehicle_id IN (SELECT vehicle_id FROM own WHERE lender_id = 1)", _HASHED, _POSITIONS, _OWN)
_put("serve_vehicle_detail", ("telemetry", "loan"), "SELECT vehicle_id, loan_id, status, oem FROM (SELECT vehicle_id, min(oem) AS oem FROM telemetry GROUP BY 1) LEFT JOIN (SELECT * FROM loan WHERE status <> 'closed') USING (vehicle_id)")
_put("serve_latest_alerts", ("alert",), "SELECT * FROM (SELECT vehicle_id, created_ts, code, row_number() OVER (PARTITION BY vehicle_id ORDER BY created_ts DESC, code) AS rank FROM (SELECT DISTINCT vehicle_id, created_ts, code FROM alert)) WHERE rank <= 50")
_put("serve_newest_open_case", ("recovery_case",), "SELECT loan_id, max(case_id) AS case_id FROM recovery_case WHERE status IN ('open', 'in_progress') GROUP BY 1")
_put("serve_trail", ("telemetry",), f"SELECT device_ts, seq, lat, lon, speed_kmh FROM telemetry WHERE vehicle_id = 'VH-000003' AND device_ts BETWEEN {NOW - 3 * 86_400} AND {NOW}")
_put("serve_leaderboard", ("alert", "loan"), "SELECT * FROM (SELECT lender_id, vehicle_id, score, row_number() OVER (PARTITION BY lender_id ORDER BY score DESC, vehicle_id) AS rank FROM board JOIN own USING (vehicle_id)) WHERE rank <= 10", _BOARD, _OWN)
_put("serve_alert_list", ("alert", "recovery_case"), "SELECT alert_id, vehicle_id, created_ts, case_id FROM alert a WHERE code = 'TOW_SUSPECTED' AND NOT EXISTS (SELECT 1 FROM recovery_case c WHERE c.case_id = a.case_id AND status IN ('recovered', 'closed'))")
_put("serve_case_list", ("alert", "loan", "agent", "recovery_case"), "SELECT case_id, vehicle_id, name AS agent, coalesce(score, 0) AS score FROM (SELECT case_id, opened_ts, agent_id, vehicle_id FROM recovery_case JOIN loan USING (loan_id)) LEFT JOIN agent USING (agent_id) LEFT JOIN board USING (vehicle_id) ORDER BY opened_ts DESC, case_id DESC LIMIT 200", _BOARD)
_put("serve_opened_cases", ("telemetry", "alert", "loan", "recovery_case"), f"""SELECT vehicle_id, loan_id, (SELECT count(*) FROM alert a WHERE a.vehicle_id = l.vehicle_id AND created_ts > {NOW - 86_400} AND created_ts <= {NOW}) AS alerts FROM loan l
WHERE status <> 'closed' AND vehicle_id IN (SELECT vehicle_id FROM telemetry) AND loan_id NOT IN (SELECT loan_id FROM recovery_case WHERE status IN ('open', 'in_progress'))""")
_put("serve_case_detail", ("alert", "recovery_case"), "SELECT case_id, status, count(alert_id) AS alerts, coalesce(min(created_ts), 0) AS first_ts FROM recovery_case LEFT JOIN alert USING (case_id) GROUP BY 1, 2")
_put("serve_updated_cases", ("loan", "agent", "recovery_case"), """SELECT case_id, CASE WHEN asked AND fits THEN coalesce(new_status, CASE WHEN new_agent_id IS NOT NULL THEN 'in_progress' END, status) ELSE status END AS status, CASE WHEN asked AND fits THEN coalesce(new_agent_id, agent_id) ELSE agent_id END AS agent_id
FROM (SELECT c.*, case_id % 3 = 0 AND l.loan_id IS NOT NULL AS asked, CASE WHEN case_id % 2 = 0 THEN 'closed' END AS new_status, CASE WHEN case_id % 5 < 3 THEN case_id % 90 END AS new_agent_id, case_id % 5 >= 3 OR coalesce(a.lender_id = l.lender_id, false) AS fits
  FROM recovery_case c LEFT JOIN loan l USING (loan_id) LEFT JOIN agent a ON a.agent_id = c.case_id % 90)""")
_put("serve_board_without_done", ("alert", "loan", "recovery_case"), "SELECT * FROM board WHERE vehicle_id NOT IN (SELECT vehicle_id FROM recovery_case c JOIN loan USING (loan_id) WHERE c.status IN ('recovered', 'closed'))", _BOARD)
_put("serve_agents", ("agent",), "SELECT agent_id, name, CASE WHEN agent_id % 2 = 0 THEN round_even(12.9::DOUBLE + agent_id / 1000::DOUBLE, 6) END AS lat FROM agent WHERE lender_id = 1")
_put("serve_risk_history", ("alert",), f"SELECT vehicle_id, max(risk_score) AS peak_score FROM alert WHERE created_ts >= {NOW - 2 * 86_400} AND created_ts < {NOW} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
_put("serve_grouped_alerts", ("alert",), "SELECT vehicle_id, code, max(created_ts) AS created_ts, count(*) AS repeats FROM alert GROUP BY 1, 2")
_put("serve_dashboard", ("alert", "recovery_case"), f"SELECT count(*) FILTER (created_ts > {NOW - 86_400 - 3600} AND created_ts <= {NOW - 86_400}) AS alerts_last_hour, count(DISTINCT vehicle_id) AS vehicles_alerted, (SELECT count(*) FROM recovery_case WHERE status IN ('open', 'in_progress')) AS open_cases FROM alert")
_put("serve_reasons", ("alert",), "SELECT vehicle_id, string_agg(code, ',' ORDER BY code) AS reasons FROM (SELECT DISTINCT vehicle_id, code FROM alert) GROUP BY 1")
_MOTION = f"motion AS (SELECT *, round_even(coalesce({_haversine('la', 'lo', 'lat', 'lon')}, 0), 3) AS moved_m, coalesce({_haversine('la', 'lo', 'lat', 'lon')}, 0) > 4 AS moving FROM (SELECT *, lag(lat) OVER w AS la, lag(lon) OVER w AS lo FROM telemetry WINDOW w AS (PARTITION BY vehicle_id ORDER BY device_ts, seq)))"
_put("serve_motion", ("telemetry",), "SELECT source_id, moved_m, moving FROM motion", _MOTION)
_put("serve_motion_counts", ("telemetry", "alert", "loan"), "SELECT count(*) AS total, count(*) FILTER (m) AS moving, count(*) FILTER (coalesce(score, 0) >= 70) AS high, count(*) FILTER (coalesce(score, 0) >= 40 AND coalesce(score, 0) < 70) AS medium FROM (SELECT vehicle_id, arg_max(moving, device_ts) AS m FROM motion GROUP BY 1) LEFT JOIN board USING (vehicle_id)", _MOTION, _BOARD)
_put("serve_masked_samples", ("payloads", "loan"), """SELECT "offset", outcome, raw FROM (SELECT arrival AS "offset", CASE WHEN bad THEN 'dead_letter' ELSE 'parsed' END AS outcome, CASE WHEN bad THEN regexp_replace(text, 'VH-[0-9]{6}', 'VH-******', 'g') ELSE text END AS raw, bad, vehicle_id
  FROM (SELECT *, row_number() OVER (ORDER BY arrival) AS r FROM judged) WHERE r % 10 = 0 ORDER BY arrival DESC LIMIT 400) WHERE bad OR vehicle_id IN (SELECT vehicle_id FROM own WHERE lender_id = 1) ORDER BY "offset" DESC LIMIT 50""", _PARSED, _OWN)

# privacy
_CELLS = "cells AS (SELECT substr(geohash, 1, 5) AS cell, count(*) AS vehicles FROM positions GROUP BY 1 HAVING count(*) >= 10)"
_put("privacy_cell_insights", ("telemetry", "alert", "loan"), "SELECT substr(geohash, 1, 5) AS cell, count(*) AS vehicles, round_even(count(*) FILTER (speed_kmh > 5) / count(*), 3) AS moving_share, round_even(avg(speed_kmh), 1) AS avg_speed_kmh, round_even(count(*) FILTER (coalesce(score, 0) > 50) / count(*), 3) AS high_risk_share FROM positions LEFT JOIN board USING (vehicle_id) GROUP BY 1 HAVING count(*) >= 10", _HASHED, _POSITIONS, _BOARD)
_put("privacy_events", ("telemetry", "alert"), f"SELECT {_PSEUDONYM} AS vehicle, code AS event, (floor(created_ts / 3600) * 3600)::BIGINT AS hour, cell FROM alert JOIN (SELECT vehicle_id, substr(geohash, 1, 5) AS cell FROM positions) USING (vehicle_id) JOIN cells USING (cell)", _HASHED, _POSITIONS, _CELLS)
_put("privacy_share", ("telemetry", "alert"), f"""SELECT cell, vehicles, vehicle, event, hour FROM cells LEFT JOIN (SELECT substr(geohash, 1, 5) AS cell, {_PSEUDONYM} AS vehicle, code AS event, (floor(created_ts / 3600) * 3600)::BIGINT AS hour
FROM alert JOIN (SELECT vehicle_id, geohash FROM positions) USING (vehicle_id) WHERE code IN ('GEOFENCE_EXIT', 'TOW_SUSPECTED') AND created_ts > {NOW - 86_400}) USING (cell)""", _HASHED, _POSITIONS, _CELLS)
_put("privacy_identities", (), "SELECT c_custkey, sha256(c_name) AS name_hash FROM customer")

# monitoring
_put("monitor_rates", ("telemetry",), """SELECT name, "at"::BIGINT AS "at", round_even(greatest(0, (value - p) / ("at" - q)), 6) AS rate FROM (SELECT *, lag(value) OVER w AS p, lag("at") OVER w AS q FROM (
  SELECT name, "at", sum(n) OVER (PARTITION BY name ORDER BY "at") AS value FROM (SELECT oem AS name, floor(ingest_ts / 600) * 600 AS "at", count(*) AS n FROM telemetry GROUP BY 1, 2)) WINDOW w AS (PARTITION BY name ORDER BY "at")) WHERE p IS NOT NULL""")
_put("monitor_latency", ("telemetry",), f"""SELECT oem, {', '.join(f"round_even(sum(x * greatest(0, 1 - abs(i - greatest(1, least(n, {q} * (n + 1) / 100.0::DOUBLE))))), 1) AS p{q}" for q in (50, 90, 99))}
FROM (SELECT oem, ingest_ts - device_ts AS x, row_number() OVER (PARTITION BY oem ORDER BY ingest_ts - device_ts) AS i, count(*) OVER (PARTITION BY oem) AS n FROM telemetry) GROUP BY 1""")
_put("monitor_raw_summary", ("payloads",), """SELECT format, count(*) AS payloads, count(*) FILTER (bad) AS unreadable, count(DISTINCT vehicle_id) FILTER (NOT bad) AS vehicles, count(*) FILTER (NOT bad AND kmh >= 5) AS moving, count(*) FILTER (NOT bad AND kmh >= 5 AND NOT ignition) AS moving_ignition_off
FROM (SELECT *, speed * CASE oem WHEN 'A' THEN 1 WHEN 'B' THEN 1.609344::DOUBLE ELSE 3.6::DOUBLE END AS kmh FROM judged) GROUP BY 1""", _PARSED)
_put("monitor_personas", ("telemetry", "alert"), "SELECT persona, " + ", ".join(f"count(*) FILTER (code = '{c}') AS \"{c}\"" for c in WEIGHTS) + " FROM (SELECT DISTINCT vehicle_id, persona FROM telemetry) LEFT JOIN alert USING (vehicle_id) GROUP BY 1")
_put("monitor_purge", ("telemetry", "alert", "recovery_case"), """SELECT 'alerts' AS name, count(*) AS n FROM kept UNION ALL SELECT 'links', count(*) FROM kept UNION ALL SELECT 'cases', count(*) FROM recovery_case WHERE case_id NOT IN (SELECT case_id FROM alert WHERE case_id NOT IN (SELECT case_id FROM kept))""",
     "truth AS (SELECT DISTINCT vehicle_id, persona FROM telemetry), kept AS (SELECT a.* FROM alert a LEFT JOIN truth USING (vehicle_id) WHERE NOT (code = 'TOW_SUSPECTED' AND coalesce(persona, -1) <> 0) AND NOT (code = 'TAMPER_SUSPECTED' AND coalesce(persona, -1) <> 1))")
_put("monitor_loan_status", ("loan",), "SELECT CASE WHEN days_past_due = 0 THEN 'current' WHEN days_past_due < 90 THEN 'overdue' ELSE 'default' END AS status, count(*) AS n FROM loan GROUP BY 1")
_put("monitor_numbered", ("alert",), "SELECT alert_id, row_number() OVER (ORDER BY alert_id) AS row_no FROM alert")


# rules that look back on their own results, step by step
def _leaving(waiting: str, newest: str, number: str, now: str) -> str:
    """How many of the waiting rows may leave: up to the first that is neither behind the watermark, next in number nor held too long."""
    return f"""(coalesce(list_position(list_transform({waiting}, lambda x, i: x.ts <= {newest} - 120 OR x.seq = coalesce({waiting}[i - 1].seq, {number}) + 1 OR x.came <= {now} - 130), false), len({waiting}) + 1) - 1)"""


def _sequence(arrivals: str) -> str:
    """``released`` (vehicle_id, seq, outcome, position) and ``stepped`` (vehicle_id, n, session) of arrivals from a table with vehicle_id, seq, ts, came and n."""
    return f"""
arrived AS ({arrivals}),
stepped(vehicle_id, n, waiting, newest, last_ts, number, top, session, gone) AS (
  SELECT DISTINCT vehicle_id, 0::BIGINT, []::STRUCT(ts DOUBLE, seq BIGINT, came DOUBLE)[], -1e18::DOUBLE, -1e18::DOUBLE, 0::BIGINT, -1::BIGINT, 0::BIGINT, []::STRUCT(seq BIGINT, late BOOLEAN)[] FROM arrived
  UNION ALL
  SELECT a.vehicle_id, a.n, w3[k2 + 1:], newest3, CASE WHEN k2 > 0 THEN w3[k2].ts ELSE last2 END, CASE WHEN k2 > 0 THEN w3[k2].seq ELSE number2 END, top3, session2,
    list_concat(list_transform(list_concat(s.waiting[:k1], CASE WHEN again THEN w1 ELSE [] END), lambda x: {{'seq': x.seq, 'late': false}}), CASE WHEN late THEN [{{'seq': a.seq, 'late': true}}] ELSE list_transform(w3[:k2], lambda x: {{'seq': x.seq, 'late': false}}) END)
  FROM stepped s JOIN arrived a ON a.vehicle_id = s.vehicle_id AND a.n = s.n + 1,
    LATERAL (SELECT {_leaving('s.waiting', 's.newest', 's.number', 'a.came')} AS k1, a.seq <= 5 AND s.top - a.seq >= 50 AS again) AS l1,
    LATERAL (SELECT s.waiting[k1 + 1:] AS w1, CASE WHEN k1 > 0 THEN s.waiting[k1].ts ELSE s.last_ts END AS last1, CASE WHEN k1 > 0 THEN s.waiting[k1].seq ELSE s.number END AS number1) AS l2,
    LATERAL (SELECT CASE WHEN again THEN [] ELSE w1 END AS w2, CASE WHEN again THEN -1e18 ELSE s.newest END AS newest2, CASE WHEN again THEN -1e18 ELSE last1 END AS last2, CASE WHEN again THEN 0 ELSE number1 END AS number2,
      CASE WHEN again THEN -1 ELSE s.top END AS top2, s.session + again::BIGINT AS session2) AS l3,
    LATERAL (SELECT a.ts < last2 OR a.ts < newest2 - 120 AS late) AS l4,
    LATERAL (SELECT CASE WHEN late THEN w2 ELSE list_sort(list_append(w2, {{'ts': a.ts, 'seq': a.seq, 'came': a.came}})) END AS w3, CASE WHEN late THEN newest2 ELSE greatest(newest2, a.ts) END AS newest3, CASE WHEN late THEN top2 ELSE greatest(top2, a.seq) END AS top3) AS l5,
    LATERAL (SELECT CASE WHEN late THEN 0 ELSE {_leaving('w3', 'newest3', 'number2', 'a.came')} END AS k2) AS l6),
let_go AS (
  SELECT vehicle_id, n, gone FROM stepped
  UNION ALL SELECT vehicle_id, n + 1, list_transform(waiting, lambda x: {{'seq': x.seq, 'late': false}}) FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY n DESC) AS r FROM stepped) WHERE r = 1),
released AS (SELECT vehicle_id, r.seq AS seq, CASE WHEN r.late THEN 'late' ELSE 'normal' END AS outcome, row_number() OVER (PARTITION BY vehicle_id ORDER BY n, i) AS position
  FROM (SELECT vehicle_id, n, unnest(gone) AS r, generate_subscripts(gone, 1) AS i FROM let_go))"""


_ARRIVAL = "SELECT vehicle_id, seq, device_s::DOUBLE AS ts, ingest_ts AS came, row_number() OVER (PARTITION BY vehicle_id ORDER BY ingest_ts, arrival) AS n"
_put("clean_reorder", ("payloads",), "SELECT vehicle_id, seq, outcome, position FROM released", _PARSED, _sequence(f"{_ARRIVAL} FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ingest_ts, arrival) AS r FROM judged WHERE NOT bad) WHERE r = 1"), recursive=True)
_put("clean_sessions", ("payloads",), 'SELECT a.vehicle_id, a.seq, a.arrival AS "offset", s.session FROM stepped s JOIN arrived a USING (vehicle_id, n)', _PARSED, _sequence(f"{_ARRIVAL}, arrival FROM judged WHERE NOT bad"), recursive=True)
_put("clean_reorder_stats", ("payloads",), "SELECT sum(s)::BIGINT AS sessions_restarted, count(*) AS vehicles_tracked FROM (SELECT vehicle_id, max(session) AS s FROM stepped GROUP BY 1)", _PARSED, _sequence(f"{_ARRIVAL} FROM judged WHERE NOT bad"), recursive=True)
_DEDUPED = """deduped AS (SELECT * FROM (SELECT *, lag(floor(ingest_ts / 600)) OVER (PARTITION BY event_id ORDER BY ingest_ts, arrival) AS last FROM judged WHERE NOT bad) WHERE last IS NULL OR last < floor(ingest_ts / 600) - 1)"""
_TRUSTED = f"""
turn AS (SELECT d.vehicle_id, d.seq, d.arrival, d.oem, device_s::DOUBLE AS ts, lat_e6::DOUBLE / 1000000::DOUBLE AS lat, lon_e6::DOUBLE / 1000000::DOUBLE AS lon, speed * CASE d.oem WHEN 'A' THEN 1 WHEN 'B' THEN 1.609344::DOUBLE ELSE 3.6::DOUBLE END AS kmh,
  outcome, row_number() OVER (PARTITION BY d.vehicle_id, outcome ORDER BY position) AS p FROM deduped d JOIN released USING (vehicle_id, seq)),
fix(vehicle_id, seq, p, suspect, flat, flon, fts) AS (
  SELECT vehicle_id, seq, p, false, lat, lon, ts FROM turn WHERE p = 1 AND outcome = 'normal'
  UNION ALL
  SELECT vehicle_id, seq, p, jump, CASE WHEN jump OR snap THEN flat ELSE lat END, CASE WHEN jump OR snap THEN flon ELSE lon END, CASE WHEN jump THEN fts ELSE ts END
  FROM (SELECT t.*, f.flat, f.flon, f.fts, t.ts > f.fts AND moved / (t.ts - f.fts) * 3.6 > 250 AS jump, t.kmh < 1 AND moved < 15 AND NOT (t.ts > f.fts AND moved / (t.ts - f.fts) * 3.6 > 250) AS snap
    FROM fix f JOIN turn t ON t.vehicle_id = f.vehicle_id AND t.p = f.p + 1 AND t.outcome = 'normal', LATERAL (SELECT {_haversine('f.flat', 'f.flon', 't.lat', 't.lon')} AS moved) AS m) AS judged_fix),
fate AS (SELECT t.arrival, t.oem, t.outcome, coalesce(f.suspect, false) AS suspect FROM turn t LEFT JOIN fix f ON t.outcome = 'normal' AND f.vehicle_id = t.vehicle_id AND f.seq = t.seq)"""
_CLEANED = (_PARSED, _DEDUPED, _sequence(f"{_ARRIVAL} FROM deduped"), _TRUSTED)
_put("clean_outcome_counts", ("payloads",), """SELECT name, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN outcome = 'normal' THEN 'normalized' ELSE 'late' END, CASE WHEN outcome = 'normal' THEN 'normalized.' || oem END, CASE WHEN suspect THEN 'suspect_gps' END], lambda x: x IS NOT NULL)) AS name FROM fate) GROUP BY 1""", *_CLEANED, recursive=True)
_put("norm_pipeline_counters", ("payloads",), """SELECT name, count(*) AS n FROM (
  SELECT unnest(list_filter(['in', 'in.' || format, CASE WHEN bad THEN 'dead_letter' END, CASE WHEN bad THEN 'dead_letter.' || reason END, CASE WHEN bad THEN 'dead_letter.oem.' || format END, CASE WHEN NOT bad THEN 'parsed' END, CASE WHEN NOT bad THEN 'parsed.' || format END], lambda x: x IS NOT NULL)) AS name FROM judged
  UNION ALL SELECT unnest(['duplicates_dropped', 'duplicates_dropped.' || oem]) FROM judged WHERE NOT bad AND arrival NOT IN (SELECT arrival FROM deduped)
  UNION ALL SELECT unnest(list_filter([CASE WHEN outcome = 'normal' THEN 'normalized' ELSE 'late' END, CASE WHEN outcome = 'normal' THEN 'normalized.' || oem END, CASE WHEN suspect THEN 'suspect_gps' END], lambda x: x IS NOT NULL)) FROM fate) GROUP BY 1""", *_CLEANED, recursive=True)
_put("norm_sample_outcomes", ("payloads",), """SELECT j.arrival AS "offset", j.format AS oem, CASE WHEN j.bad THEN 'dead_letter' WHEN f.arrival IS NULL THEN 'duplicate' WHEN f.outcome = 'late' THEN 'late' WHEN f.suspect THEN 'flagged' ELSE 'clean' END AS outcome
FROM (SELECT *, row_number() OVER (ORDER BY arrival) AS r FROM judged) j LEFT JOIN fate f USING (arrival) WHERE r % 7 = 0""", *_CLEANED, recursive=True)
_put("anomaly_tampers", ("telemetry",), """SELECT vehicle_id, 'TAMPER_SUSPECTED' AS code, ts, silent_s FROM (SELECT vehicle_id, fired AS ts, silent_s FROM watch WHERE fired IS NOT NULL
  UNION ALL SELECT w.vehicle_id, w.point, round_even(clock - w.last, 0)::BIGINT::VARCHAR FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY seq DESC) AS r FROM watch) w, (SELECT max(device_ts) AS clock FROM noisy) WHERE r = 1 AND w.point IS NOT NULL AND clock - w.last >= 900)""",
     _HASHED, _NOISE, """
odd AS (SELECT *, suspect OR battery_v < 3.6 OR max(battery_v) OVER (PARTITION BY vehicle_id ORDER BY device_ts RANGE BETWEEN 600 PRECEDING AND CURRENT ROW) - battery_v >= 0.2::DOUBLE AS is_odd FROM noisy),
watch(vehicle_id, seq, last, point, fired, silent_s) AS (
  SELECT vehicle_id, seq, device_ts, CASE WHEN is_odd THEN device_ts END, NULL::DOUBLE, NULL::VARCHAR FROM odd WHERE seq = 1
  UNION ALL
  SELECT o.vehicle_id, o.seq, o.device_ts, CASE WHEN kept IS NOT NULL THEN kept WHEN o.is_odd THEN o.device_ts END, CASE WHEN fires THEN w.point END, CASE WHEN fires THEN round_even(o.device_ts - w.last, 0)::BIGINT::VARCHAR END
  FROM watch w JOIN odd o ON o.vehicle_id = w.vehicle_id AND o.seq = w.seq + 1, LATERAL (SELECT w.point IS NOT NULL AND o.device_ts - w.last >= 900 AS fires) AS a, LATERAL (SELECT CASE WHEN NOT fires AND o.device_ts - w.point <= 900 THEN w.point END AS kept) AS b)""", recursive=True)

# cells
_BOX = """boxed AS (SELECT source_id, lat, lon, geohash, least(floor((lon + 180) / 360 * 262144), 262143)::BIGINT AS x, least(floor((lat + 90) / 180 * 131072), 131071)::BIGINT AS y FROM hashed)"""
_put("geo_cells", ("telemetry",), f"""SELECT source_id, geohash, round_even(y / 131072::DOUBLE * 180 - 90, 9) AS lat_lo, round_even((y + 1) / 131072::DOUBLE * 180 - 90, 9) AS lat_hi, round_even(x / 262144::DOUBLE * 360 - 180, 9) AS lon_lo, round_even((x + 1) / 262144::DOUBLE * 360 - 180, 9) AS lon_hi,
  concat_ws(',', {', '.join(_geohash(f"((y + {i + 0.5}) / 131072::DOUBLE * 180 - 90)", f"((x + {j + 0.5}) / 262144::DOUBLE * 360 - 180)", 7) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j)}) AS neighbours FROM boxed""", _HASHED, _BOX)


def _in(lat: str, lon: str) -> str:
    return f"(SELECT count(*) % 2 = 1 FROM side WHERE (la1 > {lat}) <> (la2 > {lat}) AND {lon} < lo1 + ({lat} - la1) * (lo2 - lo1) / (la2 - la1))"


#: Cells of 15 bits each way that the ring's bounding box meets.
_COVER = f"""
cells AS (SELECT y / 32768::DOUBLE * 180 - 90 AS s, (y + 1) / 32768::DOUBLE * 180 - 90 AS n, x / 32768::DOUBLE * 360 - 180 AS w, (x + 1) / 32768::DOUBLE * 360 - 180 AS e
  FROM (SELECT unnest(range(floor((min(lat) + 90) / 180 * 32768)::BIGINT, floor((max(lat) + 90) / 180 * 32768)::BIGINT + 1)) AS y FROM corner), (SELECT unnest(range(floor((min(lon) + 180) / 360 * 32768)::BIGINT, floor((max(lon) + 180) / 360 * 32768)::BIGINT + 1)) AS x FROM corner)),
placed AS (SELECT {_geohash('((s + n) / 2)', '((w + e) / 2)', 6)} AS cell, {' + '.join(f"{_in(a, b)}::INT" for a in 'sn' for b in 'we')} AS corners, {_in('((s + n) / 2)', '((w + e) / 2)')} AS centre, EXISTS (SELECT 1 FROM corner WHERE lat BETWEEN s AND n AND lon BETWEEN w AND e) AS vertex FROM cells),
cover AS (SELECT cell, CASE WHEN corners = 4 AND NOT vertex THEN 'inside' ELSE 'border' END AS state FROM placed WHERE corners > 0 OR centre OR vertex)"""
_put("fence_cover", ("loan",), "SELECT lender_id AS geofence_id, cell, state FROM (SELECT DISTINCT lender_id FROM loan), cover", _EDGES, _COVER)
_put("fence_exact_checks", ("telemetry", "loan"), "SELECT count(*) AS exact_checks FROM hashed JOIN own USING (vehicle_id) JOIN cover ON cell = substr(geohash, 1, 6) WHERE state = 'border'", _HASHED, _EDGES, _COVER, _OWN)

# baselines, reports, lookups
_put("snk_upsert_baselines", ("telemetry",), """SELECT p.vehicle_id, h.geohash AS home_cell, h0::INT AS active_from, (h1 + 1)::INT AS active_to FROM picked p
LEFT JOIN cell h ON h.vehicle_id = p.vehicle_id AND h.late = p.late AND h.r = 1 LEFT JOIN driven d ON d.vehicle_id = p.vehicle_id AND d.late = p.late""", _HASHED, f"""
halves AS (SELECT *, seq > 20 AS late, hour({_LOCAL}) AS h FROM hashed), picked AS (SELECT vehicle_id, bool_or(late) AS late FROM halves GROUP BY 1),
cell AS (SELECT vehicle_id, late, geohash, row_number() OVER (PARTITION BY vehicle_id, late ORDER BY count(*) DESC, geohash) AS r FROM halves WHERE speed_kmh < {MOVING_KMH} AND (h < 6 OR h >= 22) GROUP BY 1, 2, 3),
driven AS (SELECT vehicle_id, late, quantile_disc(h, 0.05) AS h0, quantile_disc(h, 0.95) AS h1 FROM halves WHERE speed_kmh >= {MOVING_KMH} GROUP BY 1, 2)""")
_put("snk_reports", ("alert", "loan"), f"SELECT lender_id, '{DAY}' AS date, vehicles, coalesce(alerts, 0) AS alerts FROM (SELECT lender_id, count(*) FILTER (status <> 'closed') AS vehicles FROM loan GROUP BY 1) LEFT JOIN (SELECT lender_id, count(*) AS alerts FROM today GROUP BY 1) USING (lender_id)", _TODAY)
_put("snk_report_of_day", ("loan", "recovery_case"), f"""SELECT lender_id, '{DAY}' AS date, count(*) AS opened FROM recovery_case JOIN loan USING (loan_id) WHERE strftime(to_timestamp(opened_ts) AT TIME ZONE 'UTC' + INTERVAL 330 MINUTE, '%Y-%m-%d') = '{DAY}' GROUP BY 1""")
_put("job_replay_rows", ("telemetry",), f"SELECT vehicle_id, count(*) AS n, min(seq) AS first_seq, 0::BIGINT AS late_marks FROM hashed WHERE strftime({_LOCAL}, '%Y-%m-%d') = '{DAY}' GROUP BY 1", _HASHED)
_put("serve_geofences", ("loan",), "SELECT 1::BIGINT AS geofence_id, k::BIGINT AS at, round_even(lat, 6) AS lat, round_even(lon, 6) AS lon FROM corner WHERE EXISTS (SELECT 1 FROM loan WHERE lender_id = 1)", _EDGES)
_put("serve_baselines", ("telemetry", "loan"), """SELECT l.vehicle_id, home.geohash AS home_cell, coalesce(h0, -1)::INT AS active_from, coalesce(h1 + 1, -1)::INT AS active_to FROM (SELECT vehicle_id FROM own) l
LEFT JOIN home ON home.vehicle_id = l.vehicle_id AND home.r = 1 LEFT JOIN drive ON drive.vehicle_id = l.vehicle_id""", _HASHED, _BASE, _OWN)

# the stream sees events after the noise filter: baselines and mean speeds are those of trusted fixes alone
_TRUSTED_DRIVE = f"drive AS (SELECT vehicle_id, quantile_disc(hour({_LOCAL}), 0.05) AS h0, quantile_disc(hour({_LOCAL}), 0.95) AS h1, avg(speed_kmh) AS m, coalesce(stddev_samp(speed_kmh), 0) AS s FROM noisy WHERE speed_kmh >= {MOVING_KMH} AND NOT suspect GROUP BY 1)"
_put("_stream_night", ("telemetry",), """SELECT vehicle_id, 'NIGHT_MOVEMENT' AS code, device_ts AS ts FROM (SELECT *, ((device_ts + 19800) % 86400) / 3600 AS x FROM noisy) LEFT JOIN drive USING (vehicle_id)
WHERE x < 5 AND ignition AND speed_kmh >= 5 AND NOT coalesce(x >= h0 AND x < h1 + 1, false)""", _HASHED, _NOISE, _TRUSTED_DRIVE, recursive=True)
_put("_stream_speed", ("telemetry",), """SELECT vehicle_id, 'SPEED_SPIKE' AS code, device_ts AS ts FROM (SELECT vehicle_id, device_ts, avg(speed_kmh) FILTER (speed_kmh >= 5 AND NOT suspect) OVER w AS mean, count(*) FILTER (speed_kmh >= 5 AND NOT suspect) OVER w AS n FROM noisy
  WINDOW w AS (PARTITION BY vehicle_id ORDER BY device_ts RANGE BETWEEN 600 PRECEDING AND CURRENT ROW)) JOIN drive USING (vehicle_id)
WHERE n >= 5 AND mean > m + 3 * s""", _HASHED, _NOISE, _TRUSTED_DRIVE, recursive=True)
_PARTS = [_ORACLES["fence_exits"], _ORACLES["anomaly_tows"], _ORACLES["anomaly_tampers"], _ORACLES.pop("_stream_night"), _ORACLES.pop("_stream_speed")]
_ORACLES["stream_signals"] = "\nUNION ALL\n".join(f"SELECT vehicle_id, code, ts FROM ({part})" for part in _PARTS)
