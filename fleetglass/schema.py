"""Schemas of the tables and the values that govern the rules."""

from __future__ import annotations

EVENT = (
    "event_id string, vehicle_id string, oem string, seq long, device_ts double, ingest_ts double, lat double, lon double, geohash string, "
    "speed_kmh double, heading_deg double, ignition boolean, battery_v double, odometer_km double, flags array<string>"
)
RAW = "payload binary, ingest_ts double, offset long"
SIGNAL = "vehicle_id string, code string, ts double, lat double, lon double, strength double, detail map<string,string>"
RING = "array<struct<lat:double,lon:double>>"

#: Weights of the signals (fixed values).
WEIGHTS = {"TOW_SUSPECTED": 30, "GEOFENCE_EXIT": 25, "TAMPER_SUSPECTED": 25, "CONVOY": 20, "ROUTE_DEVIATION": 15, "NIGHT_MOVEMENT": 10, "SPEED_SPIKE": 5}
#: Order in which an event's signals are scored; the last two come from timers and the convoy run (fixed values).
ORDINALS = {"GEOFENCE_EXIT": 0, "TOW_SUSPECTED": 1, "NIGHT_MOVEMENT": 2, "SPEED_SPIKE": 3, "ROUTE_DEVIATION": 4, "TAMPER_SUSPECTED": 5, "CONVOY": 6}

# Tunables (fixed values).
SUSPECT = "suspect_gps"
LATE = "late"
DEDUP_SLOT_S = 600
WATERMARK_S, HOLD_S, RESTART_SEQ_MAX, RESTART_MIN_DROP = 120, 130, 5, 50
STOPPED_KMH, SNAP_M, IMPLIED_KMH = 1.0, 15.0, 250.0
KM_PER_MILE = 1.609344
EXIT_AFTER, FENCE_PRECISION = 3, 6
WINDOW_S, TOW_M, TOW_FULL_M, TOW_POINTS = 600, 500.0, 1000.0, 3
NIGHT_FROM, NIGHT_TO, MOVING_KMH, SILENCE_S = 0, 5, 5.0, 900
DROP_V, LOW_V, SPIKE_STD, SPIKE_POINTS = 0.2, 3.6, 3.0, 5
LOCAL_OFFSET_S = 19_800
TRAFFIC, OFF_PATH_M, OFF_PATH_S = 0.6, 2000.0, 300
CONVOY = {"moving_kmh": 10.0, "max_m": 600.0, "max_heading": 45.0, "max_speed": 20.0, "runs": 6, "grace": 1, "size": 3}
SLOW_CONVOY = CONVOY | {"moving_kmh": 5.0, "grace": 3}
CONVOY_SLOT_S, CONVOY_FRESH_S = 300, 120
DECAY_S, MAX_DPD, CASE_SCORE, COOLDOWN_S = 86_400, 90, 70.0, 1800
MAP_STALE_S, LIVE_S, MAP_CAP = 1800, 180, 20_000
K_ANONYMITY, CELL_PRECISION = 10, 5
HOT_DAYS, TRAIL_LIMIT, TRAIL_MAX_S = 30, 20_000, 7 * 86_400
