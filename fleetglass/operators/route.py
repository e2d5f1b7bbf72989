"""Shortest paths for many pairs at once, trips and deviations from the expected path."""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cell_centre, flat_distance_m, geohash, haversine_m, neighbours, pinned
from ..schema import OFF_PATH_M, OFF_PATH_S, TRAFFIC
from ..sources.shared import written
from . import hublabels, reach
from .fence import signal_columns, trusted


def road_edges(edges: DataFrame, factor: float = TRAFFIC) -> DataFrame:
    """u, v, len_m and travel_s of the shortest of parallel edges, under a traffic factor on the speed."""
    timed = edges.withColumn("travel_s", F.col("len_m") / (F.col("speed_kmh") * factor / 3.6))
    best = F.min(F.struct("len_m", "travel_s")).alias("e")
    return timed.groupBy("u", "v").agg(best).select("u", "v", "e.len_m", "e.travel_s")


def fastest_mps(edges: DataFrame, factor: float = TRAFFIC) -> DataFrame:
    """The highest speed on any edge, one row."""
    return edges.agg(F.max(F.col("speed_kmh") * factor / 3.6).alias("max_mps"))


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("v").alias("u"), F.col("u").alias("v"), *[c for c in edges.columns if c not in ("u", "v")])


def nearest_nodes(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """point_id and node_id of the nearest node by equirectangular distance; the smaller id on ties.

    Each place is searched once, however many points are there. Places meet the nodes of their cell and its neighbours. What
    lies nearer than a cell is wide is the nearest of all; the rest try wider cells. At the widest the nearest found counts;
    a place with none even there has no row.
    """
    asked = written(points.select("point_id", "lat", "lon"), "points")
    left, found = written(asked.where("lat IS NOT NULL AND lon IS NOT NULL").select("lat", "lon").distinct(), "places"), None
    for precision in (6, 5, 4, 3, 2, 1):
        of_lon, of_lat = (5 * precision + 1) // 2, 5 * precision // 2
        width = F.least(F.lit(180.0 / (1 << of_lat)), F.lit(360.0 / (1 << of_lon)) * F.cos(F.radians("lat")))
        cells = pinned(left, _own=geohash(F.col("lat"), F.col("lon"), precision))
        cells = cells.withColumn("_cell", F.explode(F.array_distinct(F.concat(F.array("_own"), neighbours(F.col("_own"), precision)))))
        near = cells.join(nodes.select("node_id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), geohash(F.col("lat"), F.col("lon"), precision).alias("_cell")), "_cell")
        dx, dy = (F.col("_lon") - F.col("lon")) * F.cos(F.radians("lat")), F.col("_lat") - F.col("lat")
        best = near.withColumn("_d", F.sqrt(dx * dx + dy * dy)).groupBy("lat", "lon").agg(F.min(F.struct("_d", "node_id")).alias("_b"))
        sure = best.where((F.col("_b._d") <= width) | F.lit(precision == 1)).select("lat", "lon", F.col("_b.node_id").alias("node_id"))
        sure = written(sure, "snap")
        found = sure if found is None else found.unionByName(sure)
        left = written(left.join(sure, ["lat", "lon"], "left_anti"), "snap")
        if left.isEmpty():
            break
    return asked.join(found, ["lat", "lon"]).select("point_id", "node_id")


HOPS = 8


def _relaxed(frontier: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """The cheapest ways of up to ``hops`` more edges from the frontier, by source and node: cost, number of edges, where in the frontier they begin, and their nodes from there."""
    now, levels = frontier.select("src", "node", "cost", F.col("node").alias("origin"), F.array().cast("array<int>").alias("leg")), []
    for hop in range(1, hops + 1):
        now = now.join(edges, now["node"] == edges["u"]).select("src", F.col("v").alias("node"), (F.col("cost") + F.col("travel_s")).alias("cost"), "origin", F.concat("leg", F.array(F.col("v").cast("int"))).alias("leg"))
        now = now.groupBy("src", "node").agg(F.min(F.struct("cost", "origin", "leg")).alias("n")).select("src", "node", "n.*")
        levels.append(now.withColumn("hop", F.lit(hop)))
    every = functools.reduce(DataFrame.unionByName, levels)
    return every.groupBy("src", "node").agg(F.min(F.struct("cost", "hop", "origin", "leg")).alias("n")).select("src", "node", "n.*")


def _joined_legs(wanted: DataFrame, best: DataFrame) -> DataFrame:
    """src, dst, cost and path of the pairs that were reached, put together from their legs, the last one first."""
    legs = best.select("src", F.col("node").alias("_at"), "cost", "origin", "leg")
    open_ = wanted.withColumn("_at", F.col("dst")).join(legs, ["src", "_at"]).select("src", "dst", "cost", F.col("origin").alias("_at"), F.col("leg").alias("path"))
    whole = None
    while True:
        open_ = written(open_, "legs")
        done = open_.where("_at = src").select("src", "dst", "cost", F.concat(F.array(F.col("src").cast("int")), "path").alias("path"))
        whole = done if whole is None else whole.unionByName(done)
        open_ = open_.where("_at <> src")
        if open_.isEmpty():
            return whole
        open_ = open_.join(legs.drop("cost"), ["src", "_at"]).select("src", "dst", "cost", F.col("origin").alias("_at"), F.concat("leg", "path").alias("path"))


def shortest_paths(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, speeds: DataFrame) -> DataFrame:
    """src, dst, cost (seconds) and path (nodes) of the fastest way for each pair of nodes; pairs without one have no row.

    The search stays in what the pairs' ways can reach (``reach``).
    """
    return reach.within_reach(pairs, nodes, edges, lambda some, roads: _relaxed_paths(pairs, some, roads, speeds))


def _relaxed_paths(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, speeds: DataFrame) -> DataFrame:
    """``shortest_paths`` over the whole of a graph.

    All sources relax ``HOPS`` edges a round. A way is given up when its cost, with the straight line to the source's
    farthest target at the highest speed, cannot beat what is known for any of the source's targets. Only ways that ended
    at the round's last edge are carried on: shorter ones were within the round. Rounds keep the leg they added alone, at
    most ``HOPS`` nodes; the legs of the pairs asked for are joined at the end.
    """
    wanted = written(pairs.select("src", "dst").distinct(), "pairs")
    at = nodes.select("node_id", "lat", "lon")
    roads = written(edges.select("u", "v", "travel_s"), "roads")
    start = wanted.select("src", F.col("src").alias("node")).distinct()
    best = written(start.select("src", "node", F.lit(0.0).alias("cost"), F.col("src").alias("origin"), F.array().cast("array<int>").alias("leg")), "paths")
    frontier = best
    targets = written(wanted.join(at, wanted["dst"] == at["node_id"]).select("src", "dst", F.col("lat").alias("_tlat"), F.col("lon").alias("_tlon")), "targets")
    # one row, written so that rounds do not work it out again from all edges
    places, speed = written(at, "places"), written(speeds.select("max_mps"), "speed")
    while True:
        known = targets.join(best.select("src", F.col("node").alias("dst"), F.col("cost").alias("_known")), ["src", "dst"], "left")
        better = _relaxed(frontier, roads, HOPS).alias("s").join(best.select("src", "node", F.col("cost").alias("_old")), ["src", "node"], "left").where("_old IS NULL OR cost < _old").drop("_old")
        placed = better.join(places, better["node"] == places["node_id"]).select("src", "node", "cost", "lat", "lon").join(known, "src").join(F.broadcast(speed))  # one row
        hope = F.col("_known").isNull() | (F.col("cost") + haversine_m(F.col("lat"), F.col("lon"), F.col("_tlat"), F.col("_tlon")) / F.col("max_mps") <= F.col("_known") + 1e-9)
        alive = placed.groupBy("src", "node").agg(F.bool_or(hope).alias("_hope")).where("_hope").select("src", "node")
        found = written(better.join(alive, ["src", "node"], "left_semi").select("src", "node", "cost", "hop", "origin", "leg"), "paths")
        best = written(best.join(found, ["src", "node"], "left_anti").unionByName(found.drop("hop")), "paths")
        frontier = found.where(F.col("hop") == HOPS)
        if frontier.isEmpty():
            break
    return _joined_legs(wanted, best)


def label_paths(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """What ``shortest_paths`` gives, from labels of the pairs' nodes: a fixed number of steps, however long the ways are.

    Labels are built over what the pairs' ways can reach alone (``reach``).
    """
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("node"))
    return reach.within_reach(pairs, nodes, edges, lambda some, roads: hublabels.paths(pairs, hublabels.hub_labels(some, roads, ends)))


#: Edges of a graph that one task holds for searches, and sources times nodes up to which they are searched one by one.
DIRECT_EDGES, DIRECT_WORK = 1 << 20, 1 << 24


def _search(pairs: pd.DataFrame, edges: pd.DataFrame) -> Iterator[tuple[int, int, float, list[int]]]:
    """src, dst, cost and path of the fastest way of each pair, from one search for each source (Dijkstra).

    Of ways of equal cost that one is taken whose last nodes have the smallest ids, so it does not depend on what else the
    graph holds.
    """
    ids, ends = np.unique(np.concatenate([edges["u"], edges["v"]]), return_inverse=True)
    u, v = np.split(ends, 2)
    order = np.lexsort((v, u))
    heads, costs, first = v[order].tolist(), edges["travel_s"].to_numpy(dtype=float)[order].tolist(), np.searchsorted(u[order], np.arange(len(ids) + 1)).tolist()
    place = {node: n for n, node in enumerate(ids.tolist())}
    for src, own in pairs.groupby("src"):
        left = {int(d) for d in own["dst"]}
        if src in left:
            yield int(src), int(src), 0.0, [int(src)]
        wanted = {place[d] for d in left - {src} if d in place}
        if src not in place:
            continue
        begin = place[src]
        best, parent, done, heap = {begin: 0.0}, {begin: -1}, set(), [(0.0, begin)]
        while heap and wanted:
            cost, at = heapq.heappop(heap)
            if at in done:
                continue
            done.add(at)
            if at in wanted:
                wanted.remove(at)
                path, back = [], at
                while back >= 0:
                    path.append(int(ids[back]))
                    back = parent[back]
                yield int(src), int(ids[at]), cost, path[::-1]
            for k in range(first[at], first[at + 1]):
                to, way = heads[k], cost + costs[k]
                known = best.get(to)
                if known is None or way < known:
                    best[to], parent[to] = way, at
                    heapq.heappush(heap, (way, to))
                elif way == known and at < parent[to] and to not in done:
                    parent[to] = at


def _direct_paths(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, sources: int) -> DataFrame:
    """src, dst, cost and path by a search for each source; sources are dealt over tasks, each of which holds the graph."""
    known = nodes.where("node_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").select(F.col("node_id").cast("long").alias("node_id"))
    of = lambda df: functools.reduce(lambda x, end: x.join(known.withColumnRenamed("node_id", end), end, "left_semi"), df.columns[:2], df)
    blocks = max(1, min(sources, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    asked = of(pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct())
    roads = of(edges.where("u <> v AND travel_s IS NOT NULL").select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), "travel_s"))

    def run(own: pd.DataFrame, graph: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(_search(own, graph) if len(own) else [], columns=["src", "dst", "cost", "path"])

    dealt = asked.withColumn("_block", F.pmod(F.xxhash64("src"), F.lit(blocks)).cast("int"))
    each = roads.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return dealt.groupBy("_block").cogroup(each.groupBy("_block")).applyInPandas(run, "src long, dst long, cost double, path array<long>")


def fastest_paths(pairs: DataFrame, town: reach.Town) -> DataFrame:
    """What ``label_paths`` gives, for a graph that may be asked again: few sources in a small part are searched one by one.

    Labels cost many steps however few pairs there are; they are built where the searches would cost more.
    """
    asked = written(pairs.select("src", "dst").distinct(), "pairs")
    sources = asked.select("src").distinct().count()
    ends = asked.select(F.explode(F.array("src", "dst")).alias("node"))

    def search(some: DataFrame, roads: DataFrame) -> DataFrame:
        if sources * some.count() <= DIRECT_WORK and roads.count() <= DIRECT_EDGES:
            return _direct_paths(asked, some, roads, sources)
        return hublabels.paths(asked, hublabels.hub_labels(some, roads, ends))

    return town.search(asked, search)


def path_lengths(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """src, dst, cost, length_m and the path of each way."""
    legs = paths.where(F.size("path") > 1).select("src", "dst", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("u"), F.slice("path", 2, F.size("path") - 1).alias("v"))).alias("at", "leg"))
    summed = legs.select("src", "dst", "leg.u", "leg.v").join(edges.select("u", "v", "len_m"), ["u", "v"]).groupBy("src", "dst").agg(F.sum("len_m").alias("length_m"))
    return paths.join(summed, ["src", "dst"], "left").withColumn("length_m", F.coalesce("length_m", F.lit(0.0)))


def _spread(frontier: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """The cheapest labels of up to ``hops`` edges around the frontier, by group and node, with the nodes up to the frontier."""
    now, levels = frontier.select("grp", "node", "cost", "target", F.array().cast("array<int>").alias("leg")), []
    for hop in range(1, hops + 1):
        ways = now.join(edges, now["node"] == edges["v"]).select("grp", F.col("u").alias("at"), (F.col("cost") + F.col("travel_s")).alias("cost"), "target", F.concat(F.array(now["node"].cast("int")), "leg").alias("leg"))
        now = ways.groupBy("grp", "at").agg(F.min(F.struct("cost", "target", "leg")).alias("n")).select("grp", F.col("at").alias("node"), "n.*")
        levels.append(now.withColumn("hop", F.lit(hop)))
    every = functools.reduce(DataFrame.unionByName, levels)
    return every.groupBy("grp", "node").agg(F.min(F.struct("cost", "target", "hop", "leg")).alias("n")).select("grp", "node", "n.*")


def nearest_labels(targets: DataFrame, edges: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """For each group (grp, dst) and node the cheapest target to reach: cost, target, and the first nodes of the way (``leg``).

    The network's Voronoi cells: each group starts at all its targets at once and spreads against the edges, and a node keeps
    its cheapest label alone, the smaller target on ties. So the work is nodes times groups, however many sources and targets
    there are. Rounds are added, none is written again. Given ``sources`` (src, grp), a group stops beyond the label of its
    farthest source.
    """
    roads = written(edges.select("u", "v", "travel_s"), "roads")
    start = targets.select("grp", F.col("dst").alias("node"), F.lit(0.0).alias("cost"), F.col("dst").alias("target"), F.array().cast("array<int>").alias("leg")).distinct()
    frontier = written(start, "labels")
    rounds = [frontier]
    best = lambda: functools.reduce(DataFrame.unionByName, rounds).groupBy("grp", "node").agg(F.min(F.struct("cost", "target", "leg")).alias("n")).select("grp", "node", "n.*")
    while True:
        old = best().select("grp", "node", F.col("cost").alias("_cost"), F.col("target").alias("_target"))
        found = _spread(frontier, roads, HOPS).join(old, ["grp", "node"], "left").where("_cost IS NULL OR cost < _cost OR (cost = _cost AND target < _target)")
        if sources is not None:
            known = sources.select("grp", F.col("src").alias("node")).distinct().join(old, ["grp", "node"], "left")
            limit = known.groupBy("grp").agg(F.when(F.count("_cost") == F.count("*"), F.max("_cost")).alias("_limit"))
            found = found.join(limit, "grp").where("_limit IS NULL OR cost <= _limit")
        found = written(found.select("grp", "node", "cost", "target", "leg", "hop"), "labels")
        rounds.append(found.drop("hop"))
        frontier = found.where(F.col("hop") == HOPS)
        if frontier.isEmpty():
            return written(best(), "labels")


def nearest_target(sources: DataFrame, targets: DataFrame, edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """For each row of ``sources`` (src, grp) the cheapest target (dst) of its group: src, grp, dst, cost and path.

    A source from which no target of its group can be reached has no row. Paths are put together from the labels' legs.
    Given ``nodes`` (node_id, lat, lon), the search stays in what the sources' ways can reach (``reach``).
    """
    if nodes is None:
        return _nearest_target(sources, targets, edges)
    able = sources.join(targets.select("grp").distinct(), "grp", "left_semi").select("src", "grp")
    inside = lambda some: targets.join(some.select(F.col("node_id").alias("dst")), "dst", "left_semi")
    return reach.within_reach(able, nodes, edges, lambda some, roads: _nearest_target(able, inside(some), roads), ends=("src",), keys=("src", "grp"))


def _nearest_target(sources: DataFrame, targets: DataFrame, edges: DataFrame) -> DataFrame:
    wanted = written(sources.select("src", "grp").distinct(), "sources")
    labels = nearest_labels(targets, edges, wanted)
    legs = labels.select("grp", F.col("node").alias("_at"), F.col("leg").alias("_leg"))
    open_ = wanted.join(labels.withColumnRenamed("node", "src"), ["grp", "src"]).select("src", "grp", F.col("target").alias("dst"), "cost", F.concat(F.array(F.col("src").cast("int")), "leg").alias("path"))
    whole = None
    while True:
        open_ = written(open_.withColumn("_at", F.element_at("path", -1)), "legs")
        done = open_.where(F.col("_at") == F.col("dst")).drop("_at")
        whole = done if whole is None else whole.unionByName(done)
        open_ = open_.where(F.col("_at") != F.col("dst"))
        if open_.isEmpty():
            return whole
        open_ = open_.join(legs, ["grp", "_at"]).select("src", "grp", "dst", "cost", F.concat("path", "_leg").alias("path"))


def routes(requests: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """request_id, eta_s, distance_m and coordinates (lon, lat) of the way from (lat, lon) to (to_lat, to_lon)."""
    ends = requests.select(F.concat(F.lit("a"), F.col("request_id").cast("string")).alias("point_id"), "lat", "lon").unionByName(
        requests.select(F.concat(F.lit("b"), F.col("request_id").cast("string")).alias("point_id"), F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon"))
    )
    snapped = nearest_nodes(ends, nodes)
    of = lambda side, name: snapped.where(F.col("point_id").startswith(side)).select(F.substring("point_id", 2, 40).alias("_id"), F.col("node_id").alias(name))
    pairs = written(of("a", "src").join(of("b", "dst"), "_id"), "pairs")
    ways = path_lengths(label_paths(pairs, nodes, edges), edges)
    steps = ways.select("src", "dst", F.posexplode("path").alias("_at", "node_id")).join(nodes.select("node_id", "lat", "lon"), "node_id")
    point = F.struct("_at", F.array(F.bround("lon", 6), F.bround("lat", 6)).alias("p"))
    lines = steps.groupBy("src", "dst").agg(F.transform(F.array_sort(F.collect_list(point)), lambda x: x["p"]).alias("coordinates"))
    return pairs.join(ways.drop("path"), ["src", "dst"]).join(lines, ["src", "dst"]).select(F.col("_id").alias("request_id"), F.bround("cost").cast("long").alias("eta_s"), F.bround("length_m").cast("long").alias("distance_m"), "coordinates")


def trip_starts(events: DataFrame) -> DataFrame:
    """Trusted events with ``starts`` (ignition came on) and ``trip``, the number of starts so far."""
    order = Window.partitionBy("vehicle_id").orderBy("device_ts", "seq")
    starts = F.col("ignition") & ~F.coalesce(F.lag("ignition").over(order), F.lit(False))
    marked = events.where(trusted()).withColumn("starts", starts)
    return marked.withColumn("trip", F.sum(F.col("starts").cast("int")).over(order))


def destinations(starts: DataFrame, baselines: DataFrame) -> DataFrame:
    """For each trip start (vehicle_id, trip, lat, lon) the usual cell that is farthest, the first on ties."""
    cells = baselines.select("vehicle_id", F.posexplode(F.array_compact(F.array("home_cell", "work_cell"))).alias("_at", "cell"))
    joined = pinned(starts.select("vehicle_id", "trip", "lat", "lon").join(cells, "vehicle_id"), _c=cell_centre(F.col("cell"), 7))
    far = haversine_m(F.col("lat"), F.col("lon"), F.col("_c.lat"), F.col("_c.lon"))
    best = F.max_by(F.struct("cell", "_c"), F.struct(far, -F.col("_at"))).alias("_d")
    return joined.groupBy("vehicle_id", "trip", "lat", "lon").agg(best).select("vehicle_id", "trip", "lat", "lon", F.col("_d.cell").alias("cell"), F.col("_d._c.lat").alias("to_lat"), F.col("_d._c.lon").alias("to_lon"))


def _trip_ends(starts: DataFrame, baselines: DataFrame, nodes: DataFrame) -> DataFrame:
    """vehicle_id, trip, and the nodes at which the way to the expected destination begins and ends (src, dst)."""
    trips = written(destinations(starts, baselines), "trips")
    key = F.concat_ws("|", "vehicle_id", F.col("trip").cast("string"))
    ends = trips.select(F.concat(F.lit("a"), key).alias("point_id"), "lat", "lon").unionByName(trips.select(F.concat(F.lit("b"), key).alias("point_id"), F.col("to_lat").alias("lat"), F.col("to_lon").alias("lon")))
    snapped = nearest_nodes(ends, nodes)
    keyed = trips.select("vehicle_id", "trip", key.alias("_k"))
    for side, name in (("a", "src"), ("b", "dst")):
        keyed = keyed.join(snapped.where(F.col("point_id").startswith(side)).select(F.substring("point_id", 2, 60).alias("_k"), F.col("node_id").alias(name)), "_k")
    return written(keyed.drop("_k"), "trips")


def _with_points(ends: DataFrame, ways: DataFrame, nodes: DataFrame) -> DataFrame:
    points = ways.select("src", "dst", F.explode("path").alias("node_id")).join(nodes.select("node_id", "lat", "lon"), "node_id").groupBy("src", "dst").agg(F.collect_list(F.struct("lat", "lon")).alias("points"))
    return ends.join(points, ["src", "dst"]).select("vehicle_id", "trip", "points")


def expected_paths(events: DataFrame, baselines: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """vehicle_id, trip and ``points`` (lat, lon of the nodes) of the way to each trip's expected destination."""
    ends = _trip_ends(trip_starts(events).where("starts"), baselines, nodes)
    return _with_points(ends, fastest_paths(ends, reach.Town(nodes, edges)), nodes)


def trip_paths(starts: DataFrame, baselines: DataFrame, nodes: DataFrame, labels: hublabels.HubLabels | reach.Town) -> DataFrame:
    """``expected_paths`` for trip starts (vehicle_id, trip, lat, lon), from labels that stand already or from the graph."""
    ends = _trip_ends(starts, baselines, nodes)
    ways = hublabels.paths(ends, labels) if isinstance(labels, hublabels.HubLabels) else fastest_paths(ends, labels)
    return _with_points(ends, ways, nodes)


def deviations(events: DataFrame, paths: DataFrame) -> DataFrame:
    """ROUTE_DEVIATION once for each trip that stays off its path for long enough without a return."""
    driving = trip_starts(events).where("ignition").join(paths, ["vehicle_id", "trip"])
    away = F.array_min(F.transform("points", lambda p: flat_distance_m(F.col("lat"), F.col("lon"), p["lat"], p["lon"]))) > OFF_PATH_M
    order = Window.partitionBy("vehicle_id", "trip").orderBy("device_ts", "seq")
    marked = driving.withColumn("_off", away).drop("points").withColumn("_back", F.sum((~F.col("_off")).cast("int")).over(order))
    since = F.min(F.when(F.col("_off"), F.col("device_ts"))).over(Window.partitionBy("vehicle_id", "trip", "_back"))
    long = marked.withColumn("_since", since).where(F.col("_off") & (F.col("device_ts") - F.col("_since") >= OFF_PATH_S))
    first = long.withColumn("_n", F.row_number().over(order)).where("_n = 1")
    return first.select(*signal_columns(F.lit("ROUTE_DEVIATION"), F.lit(1.0), F.create_map(F.lit("off_path_s"), F.bround(F.col("device_ts") - F.col("_since")).cast("long").cast("string"))))
