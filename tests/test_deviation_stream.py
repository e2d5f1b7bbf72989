"""The stream of route deviations gives what the batch operator gives, whenever a trip's path is answered."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fleetglass.functions import geo
from fleetglass.operators import hublabels, route
from fleetglass.streaming import deviations, pipelines
from tests.test_fleet import LAT, LON, NOON, event, frame
from tests.test_streaming import in_three_batches


def town(spark):
    """A street of twelve nodes, the usual cells of two vehicles on it, and their driving; a third has no usual cells."""
    nodes = spark.createDataFrame([(i, LAT, LON + 0.006 * i) for i in range(12)], "node_id int, lat double, lon double")
    edges = spark.createDataFrame([(a, b, 650.0, 40.0) for i in range(11) for a, b in ((i, i + 1), (i + 1, i))], "u int, v int, len_m double, speed_kmh double")
    rng, rows = random.Random(4), []
    for v in (1, 2, 3):
        seq = 0
        for trip in range(4):
            begun, away = NOON + 6000 * trip + 7 * v, rng.randint(4, 20)
            back = away + rng.choice([8, 60, 60])
            for i in range(45):
                seq += 1
                off = 0.04 if away <= i < back else 0.0
                rows.append(event(seq, ts=begun + 25 * i, vehicle=f"VH-00000{v}", lat=LAT + off, lon=LON + 0.001 * i, ignition=i > 1, flags=["suspect_gps"] if i % 17 == 16 else []))
    usual = spark.createDataFrame([(f"VH-00000{v}", LAT, LON + 0.06) for v in (1, 2)], "vehicle_id string, lat double, lon double")
    base = usual.select("vehicle_id", geo.geohash(F.col("lat"), F.col("lon"), 7).alias("home_cell"), F.lit(None).cast("string").alias("work_cell"))
    return frame(spark, rows), base, nodes, route.road_edges(edges)


def keyed(rows):
    return sorted((r["vehicle_id"], r["code"], r["ts"], r["lat"], r["lon"], r["strength"], sorted(r["detail"].items())) for r in rows)


def test_deviation_stream_equals_batch(spark, tmp_path):
    events, base, nodes, edges = town(spark)
    stream = in_three_batches(spark, events, ["device_ts", "seq"], str(tmp_path / "in"))
    want = keyed(route.deviations(events, route.expected_paths(events, base, nodes, edges)).collect())
    assert {w[0] for w in want} == {"VH-000001", "VH-000002"} and len(want) > 3
    sink = deviations.path_sink(spark, str(tmp_path / "answers"), base, nodes, hublabels.hub_labels(nodes, edges))

    def twice(batch, number):
        sink(batch, number)
        sink(batch, number)

    late, got = [], []

    def follow(seen, checkpoint, **options):
        answered = deviations.answers(spark, str(tmp_path / "answers"), **options)
        pipelines.run_to_end(deviations.deviations(stream, answered), lambda batch, _: seen.extend(batch.collect()), str(tmp_path / checkpoint))

    follow(late, "late")  # nothing is answered yet, so all driving waits
    assert late == []
    pipelines.run_to_end(deviations.trip_requests(stream), twice, str(tmp_path / "asked"))
    follow(late, "late", maxFilesPerTrigger=1)
    follow(got, "soon", maxFilesPerTrigger=2)
    assert keyed(late) == want
    assert keyed(got) == want
    answered = spark.read.parquet(str(tmp_path / "answers"))
    assert answered.count() == 12 and answered.where("size(lats) = 0").select("vehicle_id").distinct().collect() == [("VH-000003",)]
