"""Telemetry and reference tables derived from the given tables by expressions that Spark and DuckDB evaluate alike.

Each entry of ``TABLES`` is SQL over the tables before it and the given ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

def _stamp(seconds: str) -> str:
    """Epoch seconds of January 2024 as local text without zone."""
    s = f"({seconds} - 1704067200)"
    two = lambda x: f"lpad(CAST({x} AS STRING), 2, '0')"
    whole = lambda x, y: f"CAST(floor({x} / {y}) AS BIGINT)"
    return f"('2024-01-' || {two(f'1 + {whole(s, 86400)}')} || 'T' || {two(f'{whole(s, 3600)} % 24')} || ':' || {two(f'{whole(s, 60)} % 60')} || ':' || {two(f'{s} % 60')})"


def _e6(column: str) -> str:
    return f"(CAST(CAST(floor({column} / 1000000) AS BIGINT) AS STRING) || '.' || lpad(CAST({column} % 1000000 AS STRING), 6, '0'))"


_A = f"""'{{"vehicle_id":"' || vehicle_id || '","seq":' || CAST(seq AS STRING) || ',"timestamp":"' || {_stamp('device_s')} || 'Z","lat":' || {_e6('lat_e6')} || ',"lon":' || {_e6('lon_e6')}
 || ',"speed_kmh":' || CAST(speed AS STRING) || '.0,"heading_deg":' || CAST(heading AS STRING) || '.0,"ignition":' || CASE WHEN ignition THEN 'true' ELSE 'false' END || ',"battery_v":' || CASE WHEN low THEN '3.7' ELSE '4.1' END
 || ',"odometer_km":' || CAST(10000 + seq AS STRING) || '.0}}'"""
_B = f"""'B|' || vehicle_id || '|' || CAST(device_s AS STRING) || '000|' || {_e6('lat_e6')} || '|' || {_e6('lon_e6')} || '|' || CAST(speed AS STRING) || '|' || CASE WHEN ignition THEN '1' ELSE '0' END || '|' || CAST(seq AS STRING)
 || '|' || CAST(heading AS STRING) || '|' || CASE WHEN low THEN '3700' ELSE '4100' END || '|' || CAST(10000 + seq AS STRING)"""
_C = f"""'{{"dev":{{"id":"' || vehicle_id || '","seq":' || CAST(seq AS STRING) || '}},"time":{{"local":"' || {_stamp('device_s + 19800')} || '","offset":"+05:30"}},"gps":{{"lat_e6":' || CAST(lat_e6 AS STRING) || ',"lon_e6":' || CAST(lon_e6 AS STRING)
 || ',"hdg":' || CAST(heading AS STRING) || '.0}},"motion":{{"spd_ms":' || CAST(speed AS STRING) || '.0}},"status":"0x0' || CASE WHEN ignition THEN '1' ELSE '0' END || '","power":{{"batt_mv":' || CASE WHEN low THEN '3700' ELSE '4100' END
 || '}},"odo_m":' || CAST((10000 + seq) * 1000 AS STRING) || '}}'"""

TABLES = {
    "readings": f"""
SELECT *, 12971600 + (grp % 5) * 4000 + CASE WHEN persona IN (2, 3, 4) THEN persona * 400 ELSE persona * 1000 END
   + CAST(sum(step_e6) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) + CASE WHEN event_id % 97 = 0 THEN 300000 ELSE 0 END AS lat_e6,
  77594600 + (grp % 7) * 3000 AS lon_e6
FROM (SELECT event_id, user_id, seq, persona, grp, 'VH-' || lpad(CAST(user_id + 1 AS STRING), 6, '0') AS vehicle_id,
  CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS oem,
  1704067200 + ((grp * 5 + 19) % 24) * 3600 + seq * 60 + CASE WHEN persona = 1 AND seq > 35 THEN 1800 ELSE 0 END AS device_s,
  CASE WHEN persona = 0 THEN CASE WHEN seq > 20 THEN 900 ELSE 0 END WHEN persona IN (2, 3, 4) THEN 2000 WHEN persona = 5 THEN 3000 ELSE ((event_id * 7919) % 7 - 3) * 300 END AS step_e6,
  CASE WHEN persona = 0 THEN CASE WHEN seq > 20 THEN 6 ELSE 0 END WHEN persona IN (2, 3, 4) THEN 40 ELSE (event_id * 31) % 60 END AS speed,
  CASE WHEN persona IN (2, 3, 4) THEN 0 ELSE (event_id * 17) % 360 END AS heading,
  persona <> 0 AND (persona IN (2, 3, 4, 5) OR (event_id * 31) % 60 >= 5) AS ignition,
  persona = 1 AND seq BETWEEN 33 AND 35 AS low
  FROM (SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq, user_id % 10 AS persona, CAST(floor(user_id / 10) AS BIGINT) AS grp FROM events) AS numbered) AS placed
""",
    "telemetry": """
SELECT event_id AS source_id, vehicle_id, oem, seq, CAST(device_s AS DOUBLE) AS device_ts,
  CAST(device_s + (event_id * 13) % 100 + CASE WHEN event_id % 53 = 0 THEN 300 ELSE 0 END AS DOUBLE) AS ingest_ts,
  CAST(lat_e6 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lat, CAST(lon_e6 AS DOUBLE) / CAST(1000000 AS DOUBLE) AS lon, CAST(speed AS DOUBLE) AS speed_kmh, CAST(heading AS DOUBLE) AS heading_deg,
  ignition, CASE WHEN low THEN CAST(3.7 AS DOUBLE) ELSE CAST(4.1 AS DOUBLE) END AS battery_v, CAST(10000 + seq AS DOUBLE) AS odometer_km, persona
FROM readings
""",
    "payloads": f"""
SELECT event_id * 2 + copy AS arrival, CAST(device_s + (event_id * 13) % 100 + CASE WHEN event_id % 53 = 0 THEN 300 ELSE 0 END + copy AS DOUBLE) AS ingest_ts,
  event_id, copy, oem, vehicle_id, seq, device_s, lat_e6, lon_e6, speed, heading, ignition, low,
  CASE WHEN event_id % 71 <> 0 THEN good WHEN event_id % 4 = 0 THEN substr(good, 1, 30) WHEN event_id % 4 = 1 THEN replace(good, '|', ';') WHEN event_id % 4 = 2 THEN replace(good, '"0x0', '"0xz') ELSE replace(good, '"seq"', '"sxq"') END AS text
FROM (SELECT r.*, c.copy, CASE oem WHEN 'A' THEN {_A} WHEN 'B' THEN {_B} ELSE {_C} END AS good
  FROM readings r JOIN (SELECT CAST(0 AS BIGINT) AS copy UNION ALL SELECT CAST(1 AS BIGINT)) AS c ON c.copy = 0 OR r.event_id % 20 = 0) AS built
""",
    "loan": """
SELECT CAST(c_custkey + 1 AS BIGINT) AS loan_id, 'VH-' || lpad(CAST(c_custkey + 1 AS STRING), 6, '0') AS vehicle_id, CAST(c_nationkey % 3 + 1 AS BIGINT) AS lender_id, CAST(300000 + (c_custkey * 37) % 1200000 AS BIGINT) AS amount,
  CAST(dpd AS INT) AS days_past_due, CASE WHEN c_custkey % 50 = 49 THEN 'closed' WHEN dpd = 0 THEN 'current' WHEN dpd < 90 THEN 'overdue' ELSE 'default' END AS status
FROM (SELECT c_custkey, c_nationkey, CASE WHEN k < 80 THEN 0 WHEN k < 92 THEN 1 + k % 30 WHEN k < 97 THEN 31 + k % 59 ELSE 90 + k % 91 END AS dpd FROM (SELECT c_custkey, c_nationkey, c_custkey % 100 AS k FROM customer) AS keyed) AS due
""",
    "agent": "SELECT CAST(s_suppkey AS BIGINT) AS agent_id, s_name AS name, CAST(s_suppkey % 3 + 1 AS BIGINT) AS lender_id FROM supplier",
    "recovery_case": """
SELECT CAST(o_orderkey AS BIGINT) AS case_id, CAST(o_custkey + 1 AS BIGINT) AS loan_id, CAST(o_orderkey % 100 AS BIGINT) AS agent_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'in_progress' WHEN 2 THEN 'recovered' WHEN 3 THEN 'closed' ELSE 'recovered' END AS status, CAST(1704067200 + (o_orderkey * 7919) % 259200 AS DOUBLE) AS opened_ts
FROM orders
""",
    "alert": """
SELECT l_orderkey * 10 + l_linenumber AS alert_id, 'VH-' || lpad(CAST(l_partkey % (SELECT max(user_id) + 1 FROM events) + 1 AS STRING), 6, '0') AS vehicle_id,
  CASE l_suppkey % 4 WHEN 0 THEN 'TOW_SUSPECTED' WHEN 1 THEN 'GEOFENCE_EXIT' WHEN 2 THEN 'TAMPER_SUSPECTED' ELSE 'SPEED_SPIKE' END AS code, CAST(1704067200 + (l_orderkey * 104729 + l_linenumber * 7919) % 259200 AS DOUBLE) AS created_ts,
  CAST(CAST((l_orderkey * 37 + l_linenumber * 11) % 10001 AS DOUBLE) / CAST(100 AS DOUBLE) AS DOUBLE) AS risk_score, l_orderkey AS case_id
FROM (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) AS lines
""",
}
BASES = {"readings": ("events",), "telemetry": ("events",), "payloads": ("events",), "loan": ("customer",), "agent": ("supplier",), "recovery_case": ("orders",), "alert": ("lineitem", "events")}
NEEDS = {"telemetry": ("readings",), "payloads": ("readings",)}


def _chain(*names: str) -> list[str]:
    out: list[str] = []
    for n in names:
        for x in (*NEEDS.get(n, ()), n):
            if x not in out:
                out.append(x)
    return out


def with_clause(*names: str) -> str:
    """A WITH clause (without the word) that defines the named tables for DuckDB."""
    return ",\n".join(f"{n} AS ({TABLES[n]})" for n in _chain(*names))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table in Spark."""
    for given in BASES[name]:
        spark.read.parquet(f"{sf_dir}/{given}.parquet").createOrReplaceTempView(given)
    clause = ",\n".join(f"{n} AS ({TABLES[n]})" for n in _chain(name))
    return spark.sql(f"WITH {clause} SELECT * FROM {name}")
