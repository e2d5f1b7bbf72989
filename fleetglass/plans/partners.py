"""What partners may see: coarse cells with enough vehicles, pseudonyms, hours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.privacy import coarse_cell, hour_of, pseudonym
from ..schema import CELL_PRECISION, K_ANONYMITY


def cell_counts(vehicles: DataFrame, precision: int = CELL_PRECISION) -> DataFrame:
    return vehicles.groupBy(coarse_cell(F.col("geohash"), precision).alias("cell")).agg(F.count("*").alias("vehicles"))


def cell_insights(vehicles: DataFrame, k: int = K_ANONYMITY, precision: int = CELL_PRECISION) -> DataFrame:
    """Figures of the coarse cells that hold at least k vehicles; vehicles have geohash, speed_kmh and score."""
    n = F.count("*")
    grouped = vehicles.groupBy(coarse_cell(F.col("geohash"), precision).alias("cell")).agg(
        n.alias("vehicles"), F.bround(F.count_if(F.col("speed_kmh") > 5) / n, 3).alias("moving_share"), F.bround(F.avg("speed_kmh"), 1).alias("avg_speed_kmh"),
        F.bround(F.count_if(F.coalesce(F.col("score"), F.lit(0.0)) > 50) / n, 3).alias("high_risk_share"),
    )
    return grouped.where(F.col("vehicles") >= k)


def anonymous_events(events: DataFrame, counts: DataFrame, key: bytes, k: int = K_ANONYMITY, precision: int = CELL_PRECISION) -> DataFrame:
    """Events (vehicle_id, code, ts, geohash) under pseudonyms, by hour and cell; rare cells are left out."""
    placed = events.withColumn("cell", coarse_cell(F.col("geohash"), precision)).join(counts.where(F.col("vehicles") >= k), "cell")
    return placed.select(pseudonym(key, F.col("vehicle_id")).alias("vehicle"), F.col("code").alias("event"), hour_of(F.col("ts")).alias("hour"), "cell")


def share(positions: DataFrame, scores: DataFrame, alerts: DataFrame, key: bytes, now: float) -> tuple[DataFrame, DataFrame]:
    """Cell figures of the live fleet, and the last day's exits and tows as anonymous events."""
    from ..functions.geo import geohash

    fleet = positions.join(scores.select("vehicle_id", "score"), "vehicle_id", "left")
    recent = alerts.where(F.col("code").isin("GEOFENCE_EXIT", "TOW_SUSPECTED") & (F.col("created_ts") > now - 86_400))
    recent = recent.select("vehicle_id", "code", F.col("created_ts").alias("ts"), geohash(F.col("lat"), F.col("lon"), CELL_PRECISION).alias("geohash"))
    return cell_insights(fleet), anonymous_events(recent, cell_counts(fleet), key)
