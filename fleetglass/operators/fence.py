"""Geofences: a cell cover that is joined by key, exact tests only at the border, exits after a run of outside events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import geohash, geohash_box, in_ring, pinned
from ..schema import EXIT_AFTER, FENCE_PRECISION, SUSPECT


def trusted() -> Column:
    return ~F.array_contains("flags", SUSPECT)


def signal_columns(code: Column, strength: Column, detail: Column, ts: str = "device_ts") -> list[Column]:
    return [F.col("vehicle_id"), code.alias("code"), F.col(ts).alias("ts"), F.col("lat"), F.col("lon"), strength.alias("strength"), detail.alias("detail")]


def cover(fences: DataFrame, precision: int = FENCE_PRECISION) -> DataFrame:
    """geofence_id, cell and state (inside or border) of every cell that a fence's ``ring`` touches.

    A cell is inside if its corners are and no vertex lies in it; border if a corner, its centre or a vertex touches.
    """
    lats, lons = F.transform("ring", lambda p: p["lat"]), F.transform("ring", lambda p: p["lon"])
    boxed = pinned(fences.where(F.size("ring") > 0), _s=F.array_min(lats), _w=F.array_min(lons), _n=F.array_max(lats), _e=F.array_max(lons))
    boxed = pinned(boxed, _corner=geohash(F.col("_s"), F.col("_w"), precision))
    boxed = pinned(boxed, _sw=geohash_box(F.col("_corner"), precision))
    sw = F.col("_sw")
    boxed = pinned(boxed, _high=sw["lat_hi"] - sw["lat_lo"], _wide=sw["lon_hi"] - sw["lon_lo"])
    rows = F.floor((F.col("_n") - sw["lat_lo"]) / F.col("_high")).cast("int")
    columns = F.floor((F.col("_e") - sw["lon_lo"]) / F.col("_wide")).cast("int")
    grid = boxed.withColumn("_i", F.explode(F.sequence(F.lit(0), rows))).withColumn("_j", F.explode(F.sequence(F.lit(0), columns)))
    grid = pinned(grid, _lat=sw["lat_lo"] + (F.col("_i") + 0.5) * F.col("_high"), _lon=sw["lon_lo"] + (F.col("_j") + 0.5) * F.col("_wide"))
    grid = pinned(grid, cell=geohash(F.col("_lat"), F.col("_lon"), precision))
    grid = pinned(grid, _b=geohash_box(F.col("cell"), precision))
    b, ring = F.col("_b"), F.col("ring")
    corners = F.array(*[in_ring(b[la], b[lo], ring) for la in ("lat_lo", "lat_hi") for lo in ("lon_lo", "lon_hi")])
    vertex = F.exists("ring", lambda p: p["lat"].between(b["lat_lo"], b["lat_hi"]) & p["lon"].between(b["lon_lo"], b["lon_hi"]))
    grid = pinned(grid, _in=corners, _vertex=vertex)
    state = F.when(F.forall("_in", lambda c: c) & ~F.col("_vertex"), "inside").when(F.exists("_in", lambda c: c) | F.col("_vertex") | in_ring(F.col("_lat"), F.col("_lon"), ring), "border")
    return grid.select("geofence_id", "cell", state.alias("state")).where("state IS NOT NULL")


def contained(events: DataFrame, vehicle_fences: DataFrame, fences: DataFrame, precision: int = FENCE_PRECISION) -> DataFrame:
    """Each event with each of its vehicle's fences: ``state`` of its cell (null if none) and ``inside``."""
    cells = cover(fences, precision).join(fences.select("geofence_id", "ring"), "geofence_id")
    paired = events.join(vehicle_fences.select("vehicle_id", "geofence_id"), "vehicle_id").withColumn("cell", F.substring("geohash", 1, precision))
    placed = paired.join(cells, ["geofence_id", "cell"], "left")
    inside = F.when(F.col("state") == "inside", True).when(F.col("state") == "border", in_ring(F.col("lat"), F.col("lon"), F.col("ring"))).otherwise(False)
    return placed.withColumn("inside", inside).drop("ring", "cell")


def exact_checks(placed: DataFrame) -> DataFrame:
    """How many events needed the exact polygon test."""
    return placed.agg(F.count_if(F.coalesce(F.col("state") == "border", F.lit(False))).alias("exact_checks"))


def exits(events: DataFrame, vehicle_fences: DataFrame, fences: DataFrame, exit_after: int = EXIT_AFTER) -> DataFrame:
    """GEOFENCE_EXIT where a run of trusted outside events reaches ``exit_after``, once for each run."""
    placed = contained(events.where(trusted()), vehicle_fences, fences)
    so_far = Window.partitionBy("vehicle_id", "geofence_id").orderBy("device_ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    outside = F.sum((~F.col("inside")).cast("int")).over(so_far)
    counted = placed.withColumn("_outside", outside)
    counted = counted.withColumn("_run", F.col("_outside") - F.coalesce(F.max(F.when(F.col("inside"), F.col("_outside"))).over(so_far), F.lit(0)))
    fired = counted.where(~F.col("inside") & (F.col("_run") == exit_after))
    return fired.select(*signal_columns(F.lit("GEOFENCE_EXIT"), F.lit(1.0), F.create_map(F.lit("geofence_id"), F.col("geofence_id").cast("string"))))
