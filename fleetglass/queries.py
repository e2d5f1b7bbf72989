"""Registered queries: each applies operators to tables that Spark derives from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures
from .functions import geo, privacy
from .operators import anomaly, clean, convoy, fence, normalise, risk, route
from .operators.numbering import numbered
from .plans import jobs, monitor, partners, serve
from .schema import EVENT, SIGNAL, SLOW_CONVOY, WEIGHTS
from .sources import raw as sources
from .sources.shared import shared_path, written
from .streaming import convoys, detectors, deviations, pipelines

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
#: A moment after all telemetry (fixed value).
NOW = 1704067200.0 + 3 * 86_400
DAY = "2024-01-02"
CENTRE = (12.9716, 77.5946)


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---------------------------------------------------------------- inputs
def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return fixtures.table(spark, sf, name)


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    raw = _table(spark, sf, "payloads").select(F.col("text").cast("binary").alias("payload"), "ingest_ts", F.col("arrival").alias("offset"))
    # parsing costs more than the bytes tell, so the derived payloads are spread as a source's files would be
    return raw.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "offset")


def _normalised(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.normalise(_raw(spark, sf))


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry as canonical events, without noise flags."""
    t = _table(spark, sf, "telemetry")
    t = t.withColumn("event_id", normalise.event_id(F.col("vehicle_id"), F.col("device_ts"), F.col("seq"))).withColumn("geohash", geo.geohash(F.col("lat"), F.col("lon"), 7))
    return t.withColumn("flags", F.array().cast("array<string>")).withColumn("offset", F.col("source_id"))


def _trusted_events(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry after the noise filter."""
    return clean.flag_noise(_events(spark, sf), "device_ts", "seq")


def _fences(spark: SparkSession, sf: str) -> DataFrame:
    """One circular zone for each lender that has loans."""
    lenders = _table(spark, sf, "loan").select("lender_id").distinct()
    return lenders.select(F.col("lender_id").alias("geofence_id"), "lender_id", geo.circle(F.lit(CENTRE[0]), F.lit(CENTRE[1]), 6000.0).alias("ring"))


def _vehicle_fences(spark: SparkSession, sf: str) -> DataFrame:
    return serve.ownership(_table(spark, sf, "loan")).select("vehicle_id", F.col("lender_id").alias("geofence_id"))


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Road nodes on a grid from the town's corner, one for each part, edges both ways, and the highest speed.

    The first hundred part keys fill a square of ten by ten row by row; each later shell of the square, one column and one
    row, holds the keys from k * k to (k + 1) * (k + 1) - 1. So the grid grows with the table, and no node moves.
    """
    ids = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_partkey").cast("int").alias("node_id")).distinct()
    shell = F.floor(F.sqrt("node_id")).cast("int")
    step = F.col("node_id") - shell * shell
    x = F.when(F.col("node_id") < 100, F.col("node_id") % 10).otherwise(F.least(shell, 2 * shell - step))
    y = F.when(F.col("node_id") < 100, F.floor(F.col("node_id") / 10).cast("int")).otherwise(F.least(step, shell))
    placed = written(ids.select("node_id", x.cast("int").alias("x"), y.cast("int").alias("y")), "nodes")
    nodes = placed.select("node_id", (12.95 + F.col("y") * 0.006).alias("lat"), (77.58 + F.col("x") * 0.006).alias("lon"))
    steps = F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    ends = placed.select(F.col("node_id").alias("u"), "x", "y", F.explode(steps).alias("s")).select("u", (F.col("x") + F.col("s.dx")).alias("x"), (F.col("y") + F.col("s.dy")).alias("y"))
    # a sorted join: what a written table takes on disk says little about what a broadcast would take
    edges = ends.join(placed.withColumnRenamed("node_id", "v").hint("merge"), ["x", "y"]).select("u", "v").withColumn("len_m", F.lit(660.0))
    edges = edges.withColumn("speed_kmh", F.element_at(F.array(F.lit(20.0), F.lit(40.0), F.lit(60.0)), ((F.col("u").cast("long") * 7 + F.col("v").cast("long") * 3) % 3 + 1).cast("int")))
    return nodes, written(route.road_edges(edges), "edges"), route.fastest_mps(edges)


def _agents(spark: SparkSession, sf: str, nodes: DataFrame) -> DataFrame:
    """grp (the lender) and dst of each agent, dealt over all nodes."""
    ranked = numbered(nodes.select("node_id"), "node_id")
    n = nodes.agg(F.count("*").alias("_n"))
    dealt = _table(spark, sf, "agent").join(F.broadcast(n)).select(F.col("lender_id").alias("grp"), (F.col("agent_id") * 37 % F.col("_n") + 1).alias("row_no"))  # one row
    return dealt.join(ranked, "row_no").select("grp", F.col("node_id").alias("dst"))


def _signals(spark: SparkSession, sf: str, convoys: bool = True) -> DataFrame:
    """The signals of all seven codes, with the time at which they fire; a replay of the vehicles' own events has no convoys."""
    return _signals_of(spark, sf, written(_trusted_events(spark, sf), "clean"), convoys)


def _signals_of(spark: SparkSession, sf: str, events: DataFrame, convoys: bool) -> DataFrame:
    base = jobs.baselines(events)
    moved = anomaly.tows_and_spikes(anomaly.movement(events), base)
    off_route = route.deviations(events, route.expected_paths(events, base, *_graph(spark, sf)[:2]))
    own = [fence.exits(events, _vehicle_fences(spark, sf), _fences(spark, sf)), moved, anomaly.night_moves(events, base), off_route]
    out = anomaly.tampers(events)
    if convoys:
        out = out.unionByName(convoy.live_signals(events))
    for part in own:
        out = out.unionByName(part.withColumn("fired_ts", F.col("ts")))
    return out


def _positions(spark: SparkSession, sf: str) -> DataFrame:
    return serve.live_positions(_events(spark, sf))


def _active(spark: SparkSession, sf: str) -> DataFrame:
    """Each vehicle's newest alert of each code as an active signal of full strength."""
    return _table(spark, sf, "alert").groupBy("vehicle_id", "code").agg(F.max("created_ts").alias("ts")).withColumn("strength", F.lit(1.0))


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return risk.rescore(_active(spark, sf), _table(spark, sf, "loan"), NOW)


# ---------------------------------------------------------------- sources and sinks
@query
def src_split_bodies(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return sources.split_bodies(docs.select("doc_id", F.col("text").alias("body")))


@query
def src_vehicle_key(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "payloads").select(F.col("arrival").alias("offset"), sources.vehicle_key(F.col("text")).alias("vehicle_key"))


@query
def src_json_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    sent = sources.to_json(sources.store_feed(_events(spark, sf), _events(spark, sf).limit(0)))
    return sources.from_json(sent).select("event_id", "vehicle_id", "seq", "device_ts", "lat", "lon", "ignition", F.size("flags").cast("long").alias("n_flags"))


@query
def src_store_feed(spark: SparkSession, sf: str) -> DataFrame:
    events = clean.behind_watermark(_events(spark, sf))
    feed = sources.store_feed(events.where("NOT late"), events.where("late"))
    return sources.storage_rows(feed).select("event_id", "device_ts", "ingest_ts", "flags")


@query
def src_raw_files(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "raw")
    _raw(spark, sf).write.parquet(path)
    return sources.raw_payloads(spark, path).select("offset", "ingest_ts", F.octet_length("payload").cast("long").alias("n_bytes"))


@query
def src_csv_types(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "csv")
    _table(spark, sf, "telemetry").select("vehicle_id", "seq", "device_ts", F.lpad(F.col("seq").cast("string"), 5, "0").alias("flags")).write.option("header", True).csv(path)
    return sources.read_csv(spark, path, "vehicle_id string, seq long, device_ts double, flags string")


@query
def snk_export_partitions(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "history")
    jobs.export(_events(spark, sf), path)
    jobs.export(_events(spark, sf).where(jobs.local_date(F.col("device_ts")) == DAY), path)
    return sources.read_days(spark, path, [DAY]).groupBy(F.col("date").cast("string").alias("date"), "cell").agg(F.count("*").alias("n"), F.count_distinct("vehicle_id").alias("vehicles"))


@query
def snk_new_rows(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    return sources.new_rows(events.unionByName(events.where("source_id % 20 = 0")), events.where("source_id % 3 = 0")).select("event_id", "vehicle_id", "seq")


@query
def snk_upsert_baselines(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    old = jobs.baselines(events.where("seq <= 20"))
    return jobs.upserted(old, jobs.baselines(events.where("seq > 20")), "vehicle_id").select("vehicle_id", "home_cell", "active_from", "active_to")


@query
def snk_retention(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.retained(jobs.export_rows(_events(spark, sf)), "2024-02-01", 30).groupBy("date").agg(F.count("*").alias("n"))


@query
def snk_latest_report(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.latest_report(_opened_by_day(spark, sf))


def _opened_by_day(spark: SparkSession, sf: str) -> DataFrame:
    daily = _table(spark, sf, "recovery_case").join(_table(spark, sf, "loan").select("loan_id", "lender_id"), "loan_id")
    return daily.groupBy("lender_id", F.date_format(jobs.local_date(F.col("opened_ts")), "yyyy-MM-dd").alias("date")).agg(F.count("*").alias("opened"))


@query
def snk_report_of_day(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.report_of(_opened_by_day(spark, sf), DAY)


@query
def snk_reports(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "reports")
    jobs.write_reports(_report(spark, sf), DAY, path)
    return jobs.read_reports(spark, path).select("lender_id", "date", "vehicles", "alerts")


# ---------------------------------------------------------------- normalisation
@query
def norm_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return _normalised(spark, sf).select("offset", "format", "reason")


@query
def norm_events(spark: SparkSession, sf: str) -> DataFrame:
    e = normalise.events(_normalised(spark, sf))
    rounded = [F.bround(c, 6).alias(c) for c in ("device_ts", "lat", "lon", "speed_kmh", "heading_deg", "battery_v", "odometer_km")]
    return e.select("offset", "event_id", "vehicle_id", "oem", "seq", "geohash", "ignition", *rounded)


@query
def norm_counters(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.counters(_normalised(spark, sf))


@query
def norm_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    letters = normalise.dead_letters(_normalised(spark, sf))
    return letters.select("offset", F.from_json("letter", "reason string, payload string, ingest_ts double").alias("l")).select("offset", "l.*")


@query
def norm_samples(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.samples(_normalised(spark, sf), every=100)


@query
def norm_pipeline_counters(spark: SparkSession, sf: str) -> DataFrame:
    rows = written(_normalised(spark, sf), "normalised")
    parsed = normalise.events(rows)
    cleaned = written(clean.clean(parsed), "cleaned")
    return normalise.counters(rows).unionByName(clean.duplicate_counts(parsed, cleaned)).unionByName(clean.outcome_counts(cleaned))


@query
def norm_sample_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rows = written(_normalised(spark, sf), "normalised")
    return normalise.sample_outcomes(rows, clean.clean(normalise.events(rows)), every=7).select("offset", "oem", "outcome")


# ---------------------------------------------------------------- cleaning
def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return normalise.events(_normalised(spark, sf))


@query
def clean_dedup_slots(spark: SparkSession, sf: str) -> DataFrame:
    return clean.dedup_by_slots(_parsed(spark, sf)).select("offset", "vehicle_id", "seq")


@query
def clean_first_of_batch(spark: SparkSession, sf: str) -> DataFrame:
    return clean.first_of_batch(_parsed(spark, sf)).select("offset", "vehicle_id", "seq")


@query
def clean_behind_watermark(spark: SparkSession, sf: str) -> DataFrame:
    return clean.behind_watermark(_parsed(spark, sf)).select("offset", "vehicle_id", "seq", "late")


@query
def clean_reorder(spark: SparkSession, sf: str) -> DataFrame:
    return clean.reorder(clean.first_of_batch(_parsed(spark, sf))).select("vehicle_id", "seq", "outcome", "position")


@query
def clean_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return clean.sessions(_parsed(spark, sf))


@query
def clean_reorder_stats(spark: SparkSession, sf: str) -> DataFrame:
    return clean.reorder_stats(clean.sessions(_parsed(spark, sf)))


@query
def clean_noise(spark: SparkSession, sf: str) -> DataFrame:
    out = _trusted_events(spark, sf)
    return out.select("vehicle_id", "seq", F.array_contains("flags", "suspect_gps").alias("suspect"), F.bround("lat", 6).alias("lat"), F.bround("lon", 6).alias("lon"), "geohash")


@query
def clean_outcome_counts(spark: SparkSession, sf: str) -> DataFrame:
    return clean.outcome_counts(clean.clean(_parsed(spark, sf)))


# ---------------------------------------------------------------- geography
@query
def geo_cells(spark: SparkSession, sf: str) -> DataFrame:
    e = written(_events(spark, sf).select("source_id", "geohash"), "placed")
    # box and neighbours are those of the cell, however many events it holds
    cells = geo.pinned(e.select("geohash").distinct(), box=geo.geohash_box(F.col("geohash"), 7), around=geo.neighbours(F.col("geohash"), 7))
    sides = [F.bround(F.col(f"box.{k}"), 9).alias(k) for k in ("lat_lo", "lat_hi", "lon_lo", "lon_hi")]
    return e.join(cells.select("geohash", *sides, F.array_join("around", ",").alias("neighbours")), "geohash").select("source_id", "geohash", "lat_lo", "lat_hi", "lon_lo", "lon_hi", "neighbours")


@query
def geo_steps(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("vehicle_id").orderBy("seq")
    e = _events(spark, sf).withColumn("la", F.lag("lat").over(order)).withColumn("lo", F.lag("lon").over(order)).where("la IS NOT NULL")
    shifted = geo.offset(F.col("lat"), F.col("lon"), 1000.0, 500.0)
    return e.select(
        "source_id", F.bround(geo.haversine_m(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")), 3).alias("metres"), F.bround(geo.bearing_deg(F.col("la"), F.col("lo"), F.lit(13.1), F.lit(77.7)), 3).alias("bearing"),
        F.bround(geo.flat_distance_m(F.col("la"), F.col("lo"), F.col("lat"), F.col("lon")), 3).alias("flat_m"), F.bround(shifted["lat"], 6).alias("north"), F.bround(shifted["lon"], 6).alias("east"),
        geo.heading_difference(F.col("heading_deg"), F.lit(350.0)).alias("turn"),
    )


@query
def geo_rings(spark: SparkSession, sf: str) -> DataFrame:
    fences = _fences(spark, sf).withColumn("again", geo.ring_from_geojson(geo.ring_to_geojson(F.col("ring"))))
    return fences.select("lender_id", F.posexplode("again").alias("at", "p")).select("lender_id", F.col("at").cast("long").alias("at"), F.bround("p.lat", 6).alias("lat"), F.bround("p.lon", 6).alias("lon"))


# ---------------------------------------------------------------- geofences
@query
def fence_cover(spark: SparkSession, sf: str) -> DataFrame:
    return fence.cover(_fences(spark, sf))


@query
def fence_contained(spark: SparkSession, sf: str) -> DataFrame:
    return fence.contained(_events(spark, sf), _vehicle_fences(spark, sf), _fences(spark, sf)).select("source_id", "geofence_id", "inside")


@query
def fence_exits(spark: SparkSession, sf: str) -> DataFrame:
    found = fence.exits(_trusted_events(spark, sf), _vehicle_fences(spark, sf), _fences(spark, sf))
    return found.select("vehicle_id", "code", "ts", F.col("detail")["geofence_id"].alias("geofence_id"))


@query
def fence_exact_checks(spark: SparkSession, sf: str) -> DataFrame:
    return fence.exact_checks(fence.contained(_events(spark, sf), _vehicle_fences(spark, sf), _fences(spark, sf)))


# ---------------------------------------------------------------- anomalies
@query
def anomaly_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = anomaly.with_window(_events(spark, sf))
    return w.select("source_id", F.size("recent").cast("long").alias("points"), F.bround(F.aggregate("recent", F.lit(0.0), lambda a, p: a + p["speed"]), 6).alias("speed_sum"))


@query
def anomaly_tows(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.tows(anomaly.movement(_trusted_events(spark, sf))).select("vehicle_id", "code", "ts", F.bround("strength", 3).alias("strength"))


@query
def anomaly_night(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    return anomaly.night_moves(events, jobs.baselines(events)).select("vehicle_id", "code", "ts", F.col("detail")["local_hour"].alias("local_hour"))


@query
def anomaly_speed(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    return anomaly.speed_spikes(anomaly.movement(events), jobs.baselines(events)).select("vehicle_id", "code", "ts")


@query
def anomaly_tampers(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.tampers(_trusted_events(spark, sf)).select("vehicle_id", "code", "ts", F.col("detail")["silent_s"].alias("silent_s"))


# ---------------------------------------------------------------- streams
def _by_time(spark: SparkSession, events: DataFrame, path: str, files: int = 3) -> DataFrame:
    """The events as a stream of files, one a batch, each of which goes on where the one before ended in event time."""
    lo, hi = events.agg(F.min("device_ts"), F.max("device_ts")).first()
    part = F.least(F.floor((F.col("device_ts") - F.lit(lo or 0.0)) / F.lit(((hi or 0.0) - (lo or 0.0) or 1.0) / files)), F.lit(files - 1))
    for at in range(files):
        events.where(part == at).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query
def stream_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Ordered events read as a stream in three batches; what the detectors' stream writes, silences by the fleet's event time."""
    out = shared_path(spark, "signals")
    events = written(_trusted_events(spark, sf).select(*[x.split(" ")[0] for x in EVENT.split(", ")]), "clean")
    fences, owned = written(_fences(spark, sf), "fences"), written(_vehicle_fences(spark, sf), "owned")
    found = detectors.signals(_by_time(spark, events, shared_path(spark, "stream")), owned, fences, written(jobs.baselines(events), "base"), "0 seconds")
    pipelines.run_to_end(found, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), shared_path(spark, "offsets"), settle=True)
    return spark.read.schema(SIGNAL + ", fired_ts double, batch long").parquet(out).select("vehicle_id", "code", "ts")


@query
def stream_convoys(spark: SparkSession, sf: str) -> DataFrame:
    """The convoy run as a stream in three batches over all telemetry; a later row of no vehicle of the fleet closes the last window."""
    out = shared_path(spark, "convoys")
    names = [x.split(" ")[0] for x in EVENT.split(", ")]
    events = written(_events(spark, sf).select(*names), "clean")
    newest = events.agg(F.max("device_ts")).first()[0] or 0.0
    end = events.limit(1).withColumn("vehicle_id", F.lit("end")).withColumn("device_ts", F.lit(newest + 3600.0)).withColumn("flags", F.array().cast("array<string>")).withColumn("speed_kmh", F.lit(0.0))
    stream = _by_time(spark, events.unionByName(end), shared_path(spark, "stream"))
    pipelines.run_to_end(convoys.closed_slots(stream, "0 seconds"), convoys.convoy_sink(spark, out), shared_path(spark, "offsets"), settle=True)
    found = spark.read.schema(convoy.LIVE + ", batch long").parquet(f"{out}/signals")
    return found.select("vehicle_id", "code", "ts", F.col("detail")["size"].cast("long").alias("size"))


@query
def stream_deviations(spark: SparkSession, sf: str) -> DataFrame:
    """Route deviations by two streams in three batches: one has the trips' paths answered, one follows the vehicles on them."""
    answered, out = shared_path(spark, "answers"), shared_path(spark, "deviations")
    nodes, edges, _ = _graph(spark, sf)
    events = written(_trusted_events(spark, sf).select(*[x.split(" ")[0] for x in EVENT.split(", ")]), "clean")
    nodes, base = written(nodes, "nodes"), written(jobs.baselines(events), "base")
    stream = _by_time(spark, events, shared_path(spark, "stream"))
    sink = deviations.path_sink(spark, answered, base, nodes, written(edges, "roads"))
    pipelines.run_to_end(deviations.trip_requests(stream), sink, shared_path(spark, "offsets"))
    found = deviations.deviations(stream, deviations.answers(spark, answered, maxFilesPerTrigger=1))
    pipelines.run_to_end(found, lambda batch, number: batch.write.mode("overwrite").parquet(f"{out}/batch={number}"), shared_path(spark, "offsets"))
    return spark.read.schema(SIGNAL + ", batch long").parquet(out).select("vehicle_id", "code", "ts")


@query
def convoy_live_signals(spark: SparkSession, sf: str) -> DataFrame:
    return convoy.live_signals(_events(spark, sf)).select("vehicle_id", "code", "ts", F.col("detail")["size"].cast("long").alias("size"))


# ---------------------------------------------------------------- routes
@query
def route_nearest_nodes(spark: SparkSession, sf: str) -> DataFrame:
    nodes, _, _ = _graph(spark, sf)
    points = _events(spark, sf).select(F.col("source_id").alias("point_id"), "lat", "lon")
    return route.nearest_nodes(points, nodes)


def _vehicle_pairs(spark: SparkSession, sf: str) -> tuple:
    """The nodes at each vehicle's first and last fix."""
    nodes, edges, speeds = _graph(spark, sf)
    ends = _events(spark, sf).groupBy("vehicle_id").agg(F.min_by(F.struct("lat", "lon"), "seq").alias("a"), F.max_by(F.struct("lat", "lon"), "seq").alias("b"))
    points = ends.select(F.concat(F.lit("a"), F.col("vehicle_id")).alias("point_id"), "a.*").unionByName(ends.select(F.concat(F.lit("b"), F.col("vehicle_id")).alias("point_id"), "b.*"))
    at = written(route.nearest_nodes(points, nodes), "ends")
    of = lambda s, n: at.where(F.col("point_id").startswith(s)).select(F.substring("point_id", 2, 20).alias("vehicle_id"), F.col("node_id").alias(n))
    return written(of("a", "src").join(of("b", "dst"), "vehicle_id"), "pairs"), nodes, edges, speeds


@query
def route_shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    pairs, nodes, edges, speeds = _vehicle_pairs(spark, sf)
    ways = route.path_lengths(route.shortest_paths(pairs, nodes, edges, speeds), edges)
    return pairs.join(ways, ["src", "dst"]).select("vehicle_id", "src", "dst", F.bround("cost", 3).alias("cost"))


@query
def route_label_paths(spark: SparkSession, sf: str) -> DataFrame:
    pairs, nodes, edges, _ = _vehicle_pairs(spark, sf)
    ways = route.label_paths(pairs, nodes, edges)
    return pairs.join(ways, ["src", "dst"]).select("vehicle_id", "src", "dst", F.bround("cost", 3).alias("cost"))


@query
def route_requests(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, _ = _graph(spark, sf)
    last = _events(spark, sf).groupBy("vehicle_id").agg(F.max_by(F.struct("lat", "lon"), "seq").alias("p"))
    asked = last.select(F.col("vehicle_id").alias("request_id"), F.lit(CENTRE[0]).alias("lat"), F.lit(CENTRE[1]).alias("lon"), F.col("p.lat").alias("to_lat"), F.col("p.lon").alias("to_lon"))
    return route.routes(asked, nodes, edges).select("request_id", "eta_s", F.size("coordinates").cast("long").alias("points"))


@query
def route_nearest_agent(spark: SparkSession, sf: str) -> DataFrame:
    pairs, nodes, edges, _ = _vehicle_pairs(spark, sf)
    own = serve.ownership(_table(spark, sf, "loan"))
    sources_ = pairs.join(own, "vehicle_id").select("vehicle_id", F.col("dst").alias("src"), F.col("lender_id").alias("grp"))
    found = route.nearest_target(sources_, _agents(spark, sf, nodes), route.reversed_edges(edges), nodes)
    return sources_.join(found, ["src", "grp"]).select("vehicle_id", F.bround("cost", 3).alias("cost"))


@query
def route_trips(spark: SparkSession, sf: str) -> DataFrame:
    return route.trip_starts(_trusted_events(spark, sf)).select("vehicle_id", "seq", "starts", F.col("trip").cast("long").alias("trip"))


@query
def route_deviations(spark: SparkSession, sf: str) -> DataFrame:
    nodes, edges, _ = _graph(spark, sf)
    events = written(_trusted_events(spark, sf), "clean")
    paths = route.expected_paths(events, jobs.baselines(events), nodes, edges)
    return route.deviations(events, paths).select("vehicle_id", "code", "ts")


# ---------------------------------------------------------------- convoys
@query
def convoy_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return convoy.snapshots(_events(spark, sf)).select("slot", "vehicle_id", "lat", "lon", "speed_kmh")


@query
def convoy_live(spark: SparkSession, sf: str) -> DataFrame:
    return convoy.live_snapshot(_events(spark, sf)).select("vehicle_id", "device_ts", "seq")


@query
def convoy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return convoy.near_pairs(convoy.snapshots(_events(spark, sf)))


@query
def convoy_edges(spark: SparkSession, sf: str) -> DataFrame:
    states = written(convoy.snapshots(_events(spark, sf)), "states")
    return convoy.edges_alive(convoy.near_pairs(states), convoy.runs(states)).select("run", "a", "b", "streak")


@query
def convoy_groups(spark: SparkSession, sf: str) -> DataFrame:
    states = written(convoy.snapshots(_events(spark, sf)), "states")
    alive = convoy.edges_alive(convoy.near_pairs(states), convoy.runs(states))
    return convoy.convoy_groups(alive).select("run", F.array_join("members", ",").alias("members"))


@query
def convoy_slow(spark: SparkSession, sf: str) -> DataFrame:
    return convoy.slow_convoys(_events(spark, sf), SLOW_CONVOY).select(F.array_join("members", ",").alias("members"))


@query
def convoy_signals(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    groups = convoy.slow_convoys(events, SLOW_CONVOY)
    stored = groups.where(F.col("members")[0] < "VH-000050")
    fresh = convoy.newly_reported(convoy.not_stored(groups, stored), stored.select(F.explode("members").alias("vehicle_id")))
    return convoy.convoy_signals(fresh, serve.live_positions(events), NOW).select("vehicle_id", "code", F.col("detail")["size"].alias("size"))


# ---------------------------------------------------------------- risk
@query
def risk_rescore(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf)


@query
def risk_decisions(spark: SparkSession, sf: str) -> DataFrame:
    decided = risk.decide(_signals(spark, sf), _table(spark, sf, "loan"), sources.open_cases(_table(spark, sf, "recovery_case"), _table(spark, sf, "loan")))
    return decided.select("vehicle_id", "code", "ts", "score", "write_alert", "open_case")


def _judged(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The alerts and cases of all signals, beside the cases that are open."""
    loans = _table(spark, sf, "loan")
    decided = written(risk.decide(_signals(spark, sf), loans, sources.open_cases(_table(spark, sf, "recovery_case"), loans)), "decided")
    return risk.alerts(decided, loans), risk.cases(decided, loans)


@query
def risk_alerts_and_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Every alert row, and every case row with the alert that opened it."""
    alerts, cases = _judged(spark, sf)
    rows = alerts.select(F.lit("alert").alias("kind"), F.col("alert_id").alias("id"), "alert_id", "vehicle_id", "loan_id", F.col("created_ts").alias("ts"), "code", F.col("risk_score").cast("double").alias("score"))
    opened = cases.select(F.lit("case").alias("kind"), F.col("case_id").alias("id"), "alert_id", "vehicle_id", "loan_id", F.col("opened_ts").alias("ts"))
    return rows.unionByName(opened, allowMissingColumns=True)


@query
def risk_counters(spark: SparkSession, sf: str) -> DataFrame:
    return risk.counters(*_judged(spark, sf))


@query
def risk_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    parts = risk.breakdown(_table(spark, sf, "alert"), _table(spark, sf, "loan"), NOW)
    return parts.select("vehicle_id", "multiplier", F.explode("parts").alias("code", "part"))


# ---------------------------------------------------------------- jobs
@query
def job_export_rows(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.export_rows(_events(spark, sf)).groupBy("date", "cell").agg(F.count("*").alias("n"))


@query
def job_replay_rows(spark: SparkSession, sf: str) -> DataFrame:
    marked = clean.behind_watermark(_events(spark, sf)).withColumn("flags", F.when(F.col("late"), F.array(F.lit("late"))).otherwise(F.col("flags"))).drop("late")
    rows = jobs.replay_rows(jobs.export_rows(marked), DAY)
    return rows.groupBy("vehicle_id").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.sum(F.size("flags").cast("long")).alias("late_marks"))


@query
def job_missing_days(spark: SparkSession, sf: str) -> DataFrame:
    history = jobs.export_rows(_events(spark, sf))
    wanted = history.select("date").distinct().limit(1).select(F.explode(jobs.day_list("2024-01-05", 5)).alias("d")).select(F.date_format("d", "yyyy-MM-dd").alias("date"))
    return jobs.missing_days(wanted, history, "2024-01-03")


@query
def job_baselines(spark: SparkSession, sf: str) -> DataFrame:
    b = jobs.baselines(_events(spark, sf))
    return b.select("vehicle_id", "home_cell", "work_cell", F.col("active_from").cast("long").alias("active_from"), F.col("active_to").cast("long").alias("active_to"), F.bround("avg_speed", 6).alias("avg_speed"), F.bround("std_speed", 6).alias("std_speed"))


@query
def job_missed_alerts(spark: SparkSession, sf: str) -> DataFrame:
    decided = risk.decide(_signals(spark, sf, convoys=False), _table(spark, sf, "loan"))
    return jobs.missed_alerts(decided, _table(spark, sf, "alert").select("vehicle_id", "code", F.col("created_ts").alias("ts"))).select("vehicle_id", "code", "ts", "score")


@query
def job_missed_of_day(spark: SparkSession, sf: str) -> DataFrame:
    """The missed alerts of one day's replay, which begins with the state that the day before left."""
    history = jobs.export_rows(_trusted_events(spark, sf))
    rows = written(jobs.replay_rows(history, DAY, before=1).drop("date", "cell"), "replay")
    decided = jobs.of_day(risk.decide(_signals_of(spark, sf, rows, convoys=False), _table(spark, sf, "loan")), DAY)
    return jobs.missed_alerts(decided, _table(spark, sf, "alert").select("vehicle_id", "code", F.col("created_ts").alias("ts"))).select("vehicle_id", "code", "ts", "score")


@query
def job_raised_scores(spark: SparkSession, sf: str) -> DataFrame:
    alerts = _table(spark, sf, "alert")
    return jobs.raised_scores(_scores(spark, sf), alerts.select("vehicle_id", F.col("risk_score").alias("score")))


def _report(spark: SparkSession, sf: str) -> DataFrame:
    loans = _table(spark, sf, "loan")
    lenders = loans.select("lender_id").distinct().withColumn("name", F.concat(F.lit("lender "), F.col("lender_id").cast("string")))
    start = NOW - 2 * 86_400 - 19_800
    return jobs.lender_report(lenders, loans, _table(spark, sf, "alert"), _table(spark, sf, "recovery_case"), start, start + 86_400)


@query
def job_report_figures(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).select("lender_id", "vehicles", "alerts", "vehicles_with_alerts", "cases_opened", "cases_recovered_30d", "cases_closed_30d", "recovery_rate_30d")


@query
def job_report_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).select("lender_id", F.inline("alerts_by_signal"))


@query
def job_report_at_risk(spark: SparkSession, sf: str) -> DataFrame:
    return _report(spark, sf).select("lender_id", F.posexplode("at_risk").alias("at", "r")).select("lender_id", F.col("at").cast("long").alias("at"), "r.vehicle_id", "r.peak_score", F.col("r.days_past_due").cast("long").alias("days_past_due"))


# ---------------------------------------------------------------- serving
@query
def serve_live_counts(spark: SparkSession, sf: str) -> DataFrame:
    return serve.live_counts(_positions(spark, sf), _table(spark, sf, "loan"), 7200)


@query
def serve_on_the_map(spark: SparkSession, sf: str) -> DataFrame:
    return serve.on_the_map(_positions(spark, sf), 40_000).select("vehicle_id", "device_ts")


@query
def serve_in_box(spark: SparkSession, sf: str) -> DataFrame:
    positions = written(serve.clustered(_positions(spark, sf)), "positions")
    return serve.in_box(positions, _table(spark, sf, "loan"), 1, _scores(spark, sf), 12.97, 13.0, 77.59, 77.61, live_s=7200).select("vehicle_id", "lat", "lon", "score")


@query
def serve_thinned(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select("source_id", "vehicle_id", F.when(F.col("persona") == 0, 10.0).otherwise(0.0).alias("score"))
    return serve.thinned(rows, 2000)


@query
def serve_owned(spark: SparkSession, sf: str) -> DataFrame:
    return serve.owned(_positions(spark, sf), _table(spark, sf, "loan"), 1).select("vehicle_id", "device_ts")


@query
def serve_vehicle_detail(spark: SparkSession, sf: str) -> DataFrame:
    t = _table(spark, sf, "telemetry")
    devices = t.groupBy("vehicle_id").agg(F.min("oem").alias("oem"))
    return serve.vehicle_detail(t.select("vehicle_id").distinct(), _table(spark, sf, "loan"), devices).select("vehicle_id", "loan_id", "status", "oem")


@query
def serve_geofences(spark: SparkSession, sf: str) -> DataFrame:
    areas = serve.lender_geofences(_fences(spark, sf), 1)
    points = areas.select("geofence_id", F.posexplode(geo.ring_from_geojson(F.col("area"))).alias("at", "p"))
    return points.select("geofence_id", F.col("at").cast("long").alias("at"), F.bround("p.lat", 6).alias("lat"), F.bround("p.lon", 6).alias("lon"))


@query
def serve_baselines(spark: SparkSession, sf: str) -> DataFrame:
    owned = serve.ownership(_table(spark, sf, "loan")).select("vehicle_id")
    found = serve.with_baseline(owned, jobs.baselines(_events(spark, sf)))
    return found.select("vehicle_id", "home_cell", *[F.coalesce(c, F.lit(-1)).alias(c) for c in ("active_from", "active_to")])


@query
def serve_latest_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return serve.latest_alerts(_table(spark, sf, "alert").dropDuplicates(["vehicle_id", "created_ts", "code"]), 50).select("vehicle_id", "created_ts", "code", F.col("rank").cast("long").alias("rank"))


@query
def serve_newest_open_case(spark: SparkSession, sf: str) -> DataFrame:
    return serve.newest_open_case(_table(spark, sf, "recovery_case"))


@query
def serve_trail(spark: SparkSession, sf: str) -> DataFrame:
    events = _events(spark, sf)
    start = NOW - 3 * 86_400
    return serve.trail(events, jobs.export_rows(events), "VH-000003", start, start + 3 * 86_400, start + 30 * 86_400 + 70_000)


@query
def serve_leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    return serve.leaderboard(_scores(spark, sf), _table(spark, sf, "loan"), 10).select("lender_id", "vehicle_id", "score", F.col("rank").cast("long").alias("rank"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "alert").select("case_id", "alert_id")


@query
def serve_alert_list(spark: SparkSession, sf: str) -> DataFrame:
    alerts, cases = _table(spark, sf, "alert").drop("case_id"), _table(spark, sf, "recovery_case")
    return serve.alert_list(alerts, cases, _links(spark, sf), "TOW_SUSPECTED", True, 10_000_000).select("alert_id", "vehicle_id", "created_ts", "case_id")


@query
def serve_case_list(spark: SparkSession, sf: str) -> DataFrame:
    return serve.case_list(_table(spark, sf, "recovery_case"), _table(spark, sf, "loan"), _table(spark, sf, "agent"), _scores(spark, sf), 200).select("case_id", "vehicle_id", "agent", "score")


@query
def serve_opened_cases(spark: SparkSession, sf: str) -> DataFrame:
    asked = _table(spark, sf, "telemetry").select("vehicle_id").distinct().withColumn("requested_ts", F.lit(NOW))
    new = serve.opened_cases(asked, _table(spark, sf, "loan"), _table(spark, sf, "recovery_case"))
    linked = serve.linked_alerts(new, _table(spark, sf, "alert"))
    counts = linked.groupBy("case_id").agg(F.count("*").alias("alerts"))
    return new.join(counts, "case_id", "left").select("vehicle_id", "loan_id", F.coalesce("alerts", F.lit(0)).alias("alerts"))


@query
def serve_case_detail(spark: SparkSession, sf: str) -> DataFrame:
    detail = serve.case_detail(_table(spark, sf, "recovery_case"), _links(spark, sf), _table(spark, sf, "alert").drop("case_id"))
    return detail.select("case_id", "status", F.size(F.coalesce("alerts", F.array())).cast("long").alias("alerts"), F.bround(F.coalesce(F.element_at("alerts", 1)["created_ts"], F.lit(0.0)), 3).alias("first_ts"))


@query
def serve_updated_cases(spark: SparkSession, sf: str) -> DataFrame:
    cases = _table(spark, sf, "recovery_case")
    updates = cases.where("case_id % 3 = 0").select("case_id", F.when(F.col("case_id") % 2 == 0, "closed").alias("new_status"), F.when(F.col("case_id") % 5 < 3, F.col("case_id") % 90).alias("new_agent_id"))
    return serve.updated_cases(cases, updates, _table(spark, sf, "loan"), _table(spark, sf, "agent")).select("case_id", "status", "agent_id")


@query
def serve_board_without_done(spark: SparkSession, sf: str) -> DataFrame:
    cases = _table(spark, sf, "recovery_case").join(_table(spark, sf, "loan").select("loan_id", "vehicle_id"), "loan_id")
    return serve.board_without_done(_scores(spark, sf), cases)


@query
def serve_agents(spark: SparkSession, sf: str) -> DataFrame:
    at = _table(spark, sf, "agent").where("agent_id % 2 = 0").select("agent_id", (F.lit(12.9) + F.col("agent_id") / 1000).alias("lat"))
    return serve.agents_of(_table(spark, sf, "agent"), at, 1).select("agent_id", "name", F.bround("lat", 6).alias("lat"))


@query
def serve_risk_history(spark: SparkSession, sf: str) -> DataFrame:
    return serve.risk_history(_table(spark, sf, "alert"), NOW - 2 * 86_400, NOW, 20)


@query
def serve_grouped_alerts(spark: SparkSession, sf: str) -> DataFrame:
    return serve.grouped_alerts(_table(spark, sf, "alert")).select("vehicle_id", "code", "created_ts", "repeats")


@query
def serve_dashboard(spark: SparkSession, sf: str) -> DataFrame:
    return serve.dashboard(_table(spark, sf, "alert"), _table(spark, sf, "recovery_case"), NOW - 86_400)


@query
def serve_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return serve.reasons(_table(spark, sf, "alert"))


@query
def serve_motion(spark: SparkSession, sf: str) -> DataFrame:
    return serve.motion(_events(spark, sf)).select("source_id", F.bround("moved_m", 3).alias("moved_m"), "moving")


@query
def serve_motion_counts(spark: SparkSession, sf: str) -> DataFrame:
    return serve.motion_counts(serve.motion(_events(spark, sf)), _scores(spark, sf))


@query
def serve_convoys(spark: SparkSession, sf: str) -> DataFrame:
    groups = convoy.slow_convoys(_events(spark, sf), SLOW_CONVOY).withColumn("convoy_id", F.xxhash64("members")).withColumn("detected_ts", F.lit(NOW))
    members = groups.select("convoy_id", F.explode("members").alias("vehicle_id"))
    own = serve.ownership(_table(spark, sf, "loan")).where("lender_id = 1")
    listed = serve.active_convoys(groups.drop("members"), members, _positions(spark, sf), own, NOW - 3600)
    return listed.select(F.array_join(F.transform("members", lambda m: m["vehicle_id"]), ",").alias("members"))


@query
def serve_masked_samples(spark: SparkSession, sf: str) -> DataFrame:
    taken = normalise.as_samples(normalise.normalise(normalise.sampled(_raw(spark, sf), every=10)))
    return serve.masked_samples(taken, _table(spark, sf, "loan"), 1).select("offset", "outcome", "raw")


# ---------------------------------------------------------------- privacy
SECRET, PARTNER = "master secret", "partner 1"


def _key() -> bytes:
    return privacy.partner_key(SECRET, PARTNER)


@query
def privacy_cell_insights(spark: SparkSession, sf: str) -> DataFrame:
    fleet = _positions(spark, sf).join(_scores(spark, sf), "vehicle_id", "left")
    return partners.cell_insights(fleet)


@query
def privacy_events(spark: SparkSession, sf: str) -> DataFrame:
    fleet = _positions(spark, sf)
    events = _table(spark, sf, "alert").select("vehicle_id", "code", F.col("created_ts").alias("ts")).join(fleet.select("vehicle_id", "geohash"), "vehicle_id")
    return partners.anonymous_events(events, partners.cell_counts(fleet), _key())


@query
def privacy_share(spark: SparkSession, sf: str) -> DataFrame:
    alerts = _table(spark, sf, "alert").join(_positions(spark, sf).select("vehicle_id", "lat", "lon"), "vehicle_id")
    cells, events = partners.share(_positions(spark, sf), _scores(spark, sf), alerts, _key(), NOW)
    return cells.select("cell", "vehicles").join(events, "cell", "left").select("cell", "vehicles", "vehicle", "event", "hour")


@query
def privacy_identities(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", privacy.hashed_identity(F.col("c_name")).alias("name_hash"))


# ---------------------------------------------------------------- monitoring
@query
def monitor_rates(spark: SparkSession, sf: str) -> DataFrame:
    order = Window.partitionBy("name").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    per = _events(spark, sf).groupBy(F.col("oem").alias("name"), (F.floor(F.col("ingest_ts") / 600) * 600).alias("at")).agg(F.count("*").alias("n"))
    return monitor.rates(per.select("name", "at", F.sum("n").over(order).alias("value"))).select("name", F.col("at").cast("long").alias("at"), F.bround("rate", 6).alias("rate"))


@query
def monitor_latency(spark: SparkSession, sf: str) -> DataFrame:
    rows = _events(spark, sf).select("oem", (F.col("ingest_ts") - F.col("device_ts")).alias("latency"))
    return monitor.latency_percentiles(rows, "latency", "oem")


@query
def monitor_raw_summary(spark: SparkSession, sf: str) -> DataFrame:
    return monitor.raw_summary(_normalised(spark, sf))


@query
def monitor_personas(spark: SparkSession, sf: str) -> DataFrame:
    personas = _table(spark, sf, "telemetry").select("vehicle_id", "persona").distinct()
    return monitor.signals_by_persona(_table(spark, sf, "alert").select("vehicle_id", "code"), personas, list(WEIGHTS))


@query
def monitor_purge(spark: SparkSession, sf: str) -> DataFrame:
    truth = _table(spark, sf, "telemetry").groupBy("vehicle_id").agg(F.bool_or(F.col("persona") == 0).alias("towed"), F.bool_or(F.col("persona") == 1).alias("tampered"))
    kept = monitor.purge_false(_table(spark, sf, "alert").drop("case_id"), _links(spark, sf), _table(spark, sf, "recovery_case"), truth)
    counts = [t.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in zip(("alerts", "links", "cases"), kept, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query
def monitor_loan_status(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf, "loan").groupBy(monitor.loan_status(F.col("days_past_due")).alias("status")).agg(F.count("*").alias("n"))


@query
def monitor_numbered(spark: SparkSession, sf: str) -> DataFrame:
    return numbered(_table(spark, sf, "alert").select("alert_id"), "alert_id").select("alert_id", F.col("row_no").cast("long").alias("row_no"))
