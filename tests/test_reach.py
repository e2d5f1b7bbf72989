"""Searches on the part of a graph that can matter find what searches on the whole graph find."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from fleetglass.operators import hublabels, reach, route

LAT, LON = 12.95, 77.58


def grid(spark, side, far=None):
    """A square of streets, and a motorway far to the south that is faster than all streets."""
    rng = random.Random(3)
    nodes = [(y * side + x, LAT + 0.006 * y, LON + 0.006 * x) for y in range(side) for x in range(side)]
    edges = []
    for y in range(side):
        for x in range(side):
            for dx, dy in ((1, 0), (0, 1)):
                if x + dx < side and y + dy < side:
                    a, b = y * side + x, (y + dy) * side + x + dx
                    edges += [(a, b, 670.0, rng.uniform(20, 40)), (b, a, 670.0, rng.uniform(20, 40))]
    if far:
        a, b = far
        n = len(nodes)
        nodes += [(n, LAT - 0.6, LON), (n + 1, LAT - 0.6, LON + 0.2)]
        edges += [(a, n, 67_000.0, 3000.0), (n, n + 1, 22_000.0, 3000.0), (n + 1, b, 67_000.0, 3000.0)]
    edges = spark.createDataFrame(edges, "u int, v int, len_m double, speed_kmh double")
    return spark.createDataFrame(nodes, "node_id int, lat double, lon double"), route.road_edges(edges)


def costs(rows):
    return {(r["src"], r["dst"]): round(r["cost"], 6) for r in rows.collect()}


def test_ways_of_a_town_need_no_other_towns_nodes_and_none_is_lost(spark):
    side = 40
    pairs = [(41, 205), (90, 90), (3, 120), (44, 8)]
    seen = []
    for far in (None, (41, 205)):
        nodes, edges = grid(spark, side, far)
        asked = spark.createDataFrame(pairs, "src int, dst int")

        def search(some, roads, asked=asked):
            seen.append(some.count())
            return hublabels.paths(asked, hublabels.hub_labels(some, roads, asked.select(F.explode(F.array("src", "dst")).alias("node"))))

        want = costs(search(nodes, edges))
        seen.clear()
        assert costs(reach.within_reach(asked, nodes, edges, search, small=0)) == want
        assert len(want) == len(pairs)
        # without the motorway a part is enough; with it the box must widen until the motorway is in
        assert (seen[-1] < side * side / 2) if far is None else (seen[-1] > side * side)


def test_pairs_without_a_way_and_nearest_targets(spark):
    nodes, edges = grid(spark, 30)
    cut = edges.where("u <> 700 AND v <> 700")  # no road there
    asked = spark.createDataFrame([(31, 700), (31, 65), (31, 99_999)], "src int, dst int")
    search = lambda some, roads: hublabels.paths(asked, hublabels.hub_labels(some, roads, asked.select(F.explode(F.array("src", "dst")).alias("node"))))
    assert costs(reach.within_reach(asked, nodes, cut, search, small=0)).keys() == {(31, 65)}
    assert reach.within_reach(asked.limit(0), nodes, cut, search, small=0).where("src < 0").count() == 0
    sources = spark.createDataFrame([(31, 1), (65, 1), (65, 2), (40, 3)], "src int, grp int")
    targets = spark.createDataFrame([(1, 280), (1, 35), (2, 899)], "grp int, dst int")
    back = route.reversed_edges(edges)
    want = {(r["src"], r["grp"], r["dst"], round(r["cost"], 6)) for r in route.nearest_target(sources, targets, back).collect()}
    inside = lambda some, roads: route.nearest_target(sources.where("grp < 3"), targets.join(some.select(F.col("node_id").alias("dst")), "dst", "left_semi"), roads)
    got = reach.within_reach(sources.where("grp < 3"), nodes, back, inside, ends=("src",), keys=("src", "grp"), small=0)
    assert {(r["src"], r["grp"], r["dst"], round(r["cost"], 6)) for r in got.collect()} == want and len(want) == 3
