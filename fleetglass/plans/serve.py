"""Serving queries as functions of tables and parameters."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import bearing_deg, box_ranges, haversine_m, ring_to_geojson
from ..schema import HOT_DAYS, LIVE_S, LOCAL_OFFSET_S, MAP_CAP, MAP_STALE_S, TRAIL_LIMIT, TRAIL_MAX_S


def ownership(loans: DataFrame) -> DataFrame:
    """vehicle_id and lender_id of loans that are not closed."""
    return loans.where("status <> 'closed'").select("vehicle_id", "lender_id")


def owned(rows: DataFrame, loans: DataFrame, lender_id: int) -> DataFrame:
    """The rows of a lender's vehicles."""
    return rows.join(ownership(loans).where(F.col("lender_id") == lender_id), "vehicle_id", "left_semi")


def lender_geofences(fences: DataFrame, lender_id: int) -> DataFrame:
    return fences.where(F.col("lender_id") == lender_id).select("geofence_id", "lender_id", ring_to_geojson(F.col("ring")).alias("area"))


def event_now(positions: DataFrame) -> DataFrame:
    """The newest report of any vehicle, one row."""
    return positions.agg(F.max("device_ts").alias("now"))


def live_positions(events: DataFrame) -> DataFrame:
    """Each vehicle's latest trusted state."""
    state = F.max(F.struct("device_ts", "seq", "lat", "lon", "speed_kmh", "heading_deg", "geohash", "ignition")).alias("s")
    return events.where(~F.array_contains("flags", "suspect_gps")).groupBy("vehicle_id").agg(state).select("vehicle_id", "s.*")


def on_the_map(positions: DataFrame, stale_s: int = MAP_STALE_S) -> DataFrame:
    """Positions newer than the cutoff behind the newest report; one exactly at the cutoff is stale."""
    return positions.join(F.broadcast(event_now(positions))).where(F.col("device_ts") > F.col("now") - stale_s).drop("now")  # one row


def live_counts(positions: DataFrame, loans: DataFrame, live_s: int = LIVE_S) -> DataFrame:
    """For each lender how many vehicles reported lately."""
    timed = positions.join(F.broadcast(event_now(positions))).join(ownership(loans), "vehicle_id")  # one row
    return timed.groupBy("lender_id").agg(F.count_if(F.col("device_ts") >= F.col("now") - live_s).alias("live"))


def clustered(positions: DataFrame) -> DataFrame:
    """Positions in the order of their cells over all partitions, so that files and row groups hold neighbours."""
    return positions.repartitionByRange("geohash").sortWithinPartitions("geohash")


def in_box(positions: DataFrame, loans: DataFrame, lender_id: int, scores: DataFrame, lat_lo: float, lat_hi: float, lon_lo: float, lon_hi: float, least_km: float = 0.1, live_s: int = LIVE_S) -> DataFrame:
    """A lender's vehicles that reported lately in a box of at least ``least_km`` each way, with their score or 0.

    Positions with the ``geohash`` of their place (7 letters; null if it is not known) are read by ranges of cells, so that a
    table that ``clustered`` laid out is read in part.
    """
    pad_lat = max(0.0, least_km / 111.32 - (lat_hi - lat_lo)) / 2
    pad_lon = max(0.0, least_km / 111.32 - (lon_hi - lon_lo)) / 2
    box = (lat_lo - pad_lat, lat_hi + pad_lat, lon_lo - pad_lon, lon_hi + pad_lon)
    inside = F.col("lat").between(*box[:2]) & F.col("lon").between(*box[2:])
    if "geohash" in positions.columns:
        cells = [F.col("geohash").between(first, last) for first, last in box_ranges(*box)]
        inside = functools.reduce(lambda a, b: a | b, cells, F.col("geohash").isNull()) & inside
    fresh = positions.join(F.broadcast(event_now(positions))).where(F.col("device_ts") >= F.col("now") - live_s).drop("now")  # one row
    return owned(fresh.where(inside), loans, lender_id).join(scores.select("vehicle_id", "score"), "vehicle_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def thinned(rows: DataFrame, cap: int = MAP_CAP) -> DataFrame:
    """An even, stable part of the rows when they exceed the cap; rows at risk always stay."""
    n = rows.agg(F.count("*").alias("_n"))
    step = F.greatest(F.ceil(F.col("_n") / cap), F.lit(1))
    return rows.join(F.broadcast(n)).where((F.col("score") > 0) | (F.crc32(F.col("vehicle_id").cast("binary")) % step == 0)).drop("_n")  # one row


def vehicle_detail(vehicles: DataFrame, loans: DataFrame, devices: DataFrame) -> DataFrame:
    """Vehicles with their model, open loan and device; null where there is none."""
    return vehicles.join(loans.where("status <> 'closed'"), "vehicle_id", "left").join(devices, "vehicle_id", "left")


def with_baseline(vehicles: DataFrame, baselines: DataFrame) -> DataFrame:
    """Vehicles with their usual cells, the bounds of their driving hours and speeds; null where nothing was learned."""
    return vehicles.join(baselines.select("vehicle_id", "home_cell", "work_cell", "active_from", "active_to", "avg_speed", "std_speed"), "vehicle_id", "left")


def latest_alerts(alerts: DataFrame, per_vehicle: int = 50) -> DataFrame:
    """The newest alerts of each vehicle."""
    rank = F.row_number().over(Window.partitionBy("vehicle_id").orderBy(F.desc("created_ts"), "code"))
    return alerts.withColumn("rank", rank).where(F.col("rank") <= per_vehicle)


def newest_open_case(cases: DataFrame) -> DataFrame:
    """loan_id and the newest case that is open or in progress."""
    return cases.where(F.col("status").isin("open", "in_progress")).groupBy("loan_id").agg(F.max("case_id").alias("case_id"))


def trail(hot: DataFrame, history: DataFrame, vehicle_id: str, start: float, end: float, now: float, limit: int = TRAIL_LIMIT) -> DataFrame:
    """A vehicle's points in a range of at most a week, in order: from history before the hot period, else from hot."""
    if not 0 <= end - start <= TRAIL_MAX_S:
        raise ValueError("a trail covers at most seven days")
    split = now - HOT_DAYS * 86_400
    wanted = (F.col("vehicle_id") == vehicle_id) & F.col("device_ts").between(start, end)
    columns = ["device_ts", "seq", "lat", "lon", "speed_kmh"]
    recent = hot.where(wanted & (F.col("device_ts") >= split)).orderBy("device_ts", "seq").limit(limit).select(*columns)
    days = F.col("date").between(*[F.date_format(F.timestamp_seconds(F.lit(t) + LOCAL_OFFSET_S), "yyyy-MM-dd") for t in (start, end)])
    cold = history.where(days & wanted & (F.col("device_ts") < split)).select(*columns)
    return cold.unionByName(recent).orderBy("device_ts", "seq")


def leaderboard(scores: DataFrame, loans: DataFrame, k: int = 10) -> DataFrame:
    """The k highest scores of each lender."""
    rank = F.row_number().over(Window.partitionBy("lender_id").orderBy(F.desc("score"), "vehicle_id"))
    return scores.join(ownership(loans), "vehicle_id").withColumn("rank", rank).where(F.col("rank") <= k)


def alert_list(alerts: DataFrame, cases: DataFrame, case_alerts: DataFrame, code: str | None = None, open_only: bool = False, limit: int = 100) -> DataFrame:
    """Newest alerts, with one case each; open ones have no recovered or closed case."""
    rows = alerts.where(F.col("code") == code) if code else alerts
    if open_only:
        done = case_alerts.join(cases.where(F.col("status").isin("recovered", "closed")), "case_id").select("alert_id")
        rows = rows.join(done, "alert_id", "left_anti")
    linked = case_alerts.groupBy("alert_id").agg(F.min("case_id").alias("case_id"))
    return rows.join(linked, "alert_id", "left").orderBy(F.desc("created_ts"), "vehicle_id", "code").limit(limit)


def active_convoys(convoys: DataFrame, members: DataFrame, positions: DataFrame, own: DataFrame, since: float) -> DataFrame:
    """Convoys detected since, with this lender's members in order and their positions; those without any are left out."""
    mine = members.join(own, "vehicle_id", "left_semi").join(positions.select("vehicle_id", "lat", "lon"), "vehicle_id", "left")
    listed = mine.groupBy("convoy_id").agg(F.array_sort(F.collect_list(F.struct("vehicle_id", "lat", "lon"))).alias("members"))
    return convoys.where(F.col("detected_ts") >= since).join(listed, "convoy_id")


def case_list(cases: DataFrame, loans: DataFrame, agents: DataFrame, scores: DataFrame, limit: int = 200) -> DataFrame:
    """The newest cases with vehicle, agent's name and score."""
    rows = cases.join(loans.select("loan_id", F.col("vehicle_id").alias("_v"), "lender_id"), "loan_id").withColumn("vehicle_id", F.coalesce("vehicle_id", "_v") if "vehicle_id" in cases.columns else F.col("_v")).drop("_v")
    rows = rows.join(agents.select("agent_id", F.col("name").alias("agent")), "agent_id", "left").join(scores.select("vehicle_id", "score"), "vehicle_id", "left")
    return rows.withColumn("score", F.coalesce("score", F.lit(0.0))).orderBy(F.desc("opened_ts"), F.desc("case_id")).limit(limit)


def opened_cases(requests: DataFrame, loans: DataFrame, cases: DataFrame) -> DataFrame:
    """A case for each requested vehicle with an open loan and no open case."""
    loan = requests.join(loans.where("status <> 'closed'").select("vehicle_id", "loan_id"), "vehicle_id")
    new = loan.join(cases.where(F.col("status").isin("open", "in_progress")).select("loan_id"), "loan_id", "left_anti")
    return new.select(F.xxhash64("loan_id", "requested_ts").alias("case_id"), F.col("requested_ts").alias("opened_ts"), F.lit("open").alias("status"), "loan_id", "vehicle_id")


def linked_alerts(new_cases: DataFrame, alerts: DataFrame, hours: int = 24) -> DataFrame:
    """case_id and alert_id of the vehicle's alerts in the hours before a case was opened."""
    joined = new_cases.join(alerts.select("vehicle_id", "alert_id", "created_ts"), "vehicle_id")
    return joined.where((F.col("created_ts") > F.col("opened_ts") - hours * 3600) & (F.col("created_ts") <= F.col("opened_ts"))).select("case_id", "alert_id")


def case_detail(cases: DataFrame, case_alerts: DataFrame, alerts: DataFrame) -> DataFrame:
    """Cases with their alerts in order of time."""
    listed = case_alerts.join(alerts.select("alert_id", "created_ts", "code", "risk_score"), "alert_id")
    listed = listed.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("created_ts", "code", "risk_score"))).alias("alerts"))
    return cases.join(listed, "case_id", "left")


def updated_cases(cases: DataFrame, updates: DataFrame, loans: DataFrame, agents: DataFrame) -> DataFrame:
    """Cases after updates (case_id, new_status, new_agent_id): an agent of another lender is ignored with its update.

    The status becomes the new one, else in_progress if an agent is given, else it stays.
    """
    lender = loans.select("loan_id", F.col("lender_id").alias("_lender"))
    asked = updates.join(cases.select("case_id", "loan_id").join(lender, "loan_id").select("case_id", "_lender"), "case_id")
    fits = asked.join(agents.select(F.col("agent_id").alias("new_agent_id"), F.col("lender_id").alias("_of")), "new_agent_id", "left").where("new_agent_id IS NULL OR _of = _lender")
    joined = cases.join(fits.select("case_id", "new_status", "new_agent_id", F.lit(True).alias("_asked")), "case_id", "left")
    status = F.coalesce("new_status", F.when(F.col("new_agent_id").isNotNull(), "in_progress"), "status")
    return joined.withColumn("status", F.when(F.col("_asked"), status).otherwise(F.col("status"))).withColumn("agent_id", F.coalesce("new_agent_id", "agent_id")).drop("new_status", "new_agent_id", "_asked")


def board_without_done(board: DataFrame, cases: DataFrame) -> DataFrame:
    """The leaderboard without vehicles whose case is recovered or closed."""
    return board.join(cases.where(F.col("status").isin("recovered", "closed")).select("vehicle_id"), "vehicle_id", "left_anti")


def agents_of(agents: DataFrame, positions: DataFrame, lender_id: int) -> DataFrame:
    return agents.where(F.col("lender_id") == lender_id).join(positions, "agent_id", "left")


def risk_history(alerts: DataFrame, start: float, end: float, k: int = 20) -> DataFrame:
    """The k vehicles with the highest alert score in a range."""
    peak = alerts.where((F.col("created_ts") >= start) & (F.col("created_ts") < end)).groupBy("vehicle_id").agg(F.max("risk_score").alias("peak_score"))
    return peak.orderBy(F.desc("peak_score"), "vehicle_id").limit(k)


def grouped_alerts(alerts: DataFrame) -> DataFrame:
    """The newest alert of each vehicle and code, and how many there are."""
    last = F.max_by(F.struct("created_ts", "risk_score"), "created_ts").alias("_l")
    return alerts.groupBy("vehicle_id", "code").agg(last, F.count("*").alias("repeats")).select("vehicle_id", "code", "_l.*", "repeats")


def dashboard(alerts: DataFrame, cases: DataFrame, now: float) -> DataFrame:
    """Open cases and the last hour's alerts, one row."""
    hour = alerts.agg(F.count_if((F.col("created_ts") > now - 3600) & (F.col("created_ts") <= now)).alias("alerts_last_hour"), F.count_distinct("vehicle_id").alias("vehicles_alerted"))
    return hour.join(cases.agg(F.count_if(F.col("status").isin("open", "in_progress")).alias("open_cases")))  # one row each


def reasons(alerts: DataFrame) -> DataFrame:
    """For each vehicle the codes of its alerts."""
    return alerts.groupBy("vehicle_id").agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("reasons"))


def risk_band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 40, "medium").otherwise("low")


def motion(events: DataFrame, least_m: float = 4.0) -> DataFrame:
    """Each event with ``moved_m`` since the vehicle's last, ``moving`` and the bearing of the step."""
    order = Window.partitionBy("vehicle_id").orderBy("device_ts", "seq")
    lat, lon = F.lag("lat").over(order), F.lag("lon").over(order)
    stepped = events.withColumn("_lat", lat).withColumn("_lon", lon)
    moved = haversine_m(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon"))
    out = stepped.withColumn("moved_m", F.coalesce(moved, F.lit(0.0))).withColumn("moving", F.col("moved_m") > least_m)
    return out.withColumn("bearing", F.when(F.col("moving"), bearing_deg(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))).drop("_lat", "_lon")


def motion_counts(moves: DataFrame, scores: DataFrame) -> DataFrame:
    """Vehicles in total, moving at their last step, and by risk band; one row."""
    last = moves.groupBy("vehicle_id").agg(F.max_by("moving", F.struct("device_ts", "seq")).alias("moving"))
    scored = last.join(scores.select("vehicle_id", "score"), "vehicle_id", "left").withColumn("band", risk_band(F.coalesce("score", F.lit(0.0))))
    return scored.agg(F.count("*").alias("total"), F.count_if("moving").alias("moving"), F.count_if(F.col("band") == "high").alias("high"), F.count_if(F.col("band") == "medium").alias("medium"))


def masked_samples(samples: DataFrame, loans: DataFrame, lender_id: int, limit: int = 50, of: int = 400) -> DataFrame:
    """The newest samples that concern a lender: its own vehicles' and dead letters, in these every vehicle id masked."""
    newest = samples.orderBy(F.desc("offset")).limit(of).withColumn("vehicle_id", F.regexp_extract("raw", r"VH-\d{6}", 0))
    mine = newest.where("outcome <> 'dead_letter'").join(ownership(loans).where(F.col("lender_id") == lender_id), "vehicle_id", "left_semi")
    dead = newest.where("outcome = 'dead_letter'").withColumn("raw", F.regexp_replace("raw", r"VH-\d{6}", "VH-******"))
    return mine.unionByName(dead).drop("vehicle_id").orderBy(F.desc("offset")).limit(limit)

