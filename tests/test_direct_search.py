"""Few sources are searched one by one, a stream's batches share the graph, and answers go to as many files as they fill."""

from __future__ import annotations

import random

from fleetglass.operators import hublabels, reach, route
from fleetglass.streaming import deviations
from tests.test_deviation_stream import town as streets
from tests.test_fleet import LAT, LON
from tests.test_hub_labels import town
from tests.test_reach import grid


def test_direct_search_equals_labels(spark, monkeypatch):
    places, edges = town(5)
    nodes = spark.createDataFrame([(i, *p) for i, p in places.items()] + [(None, 0.1, 0.1), (9000, None, 0.1)], "node_id int, lat double, lon double")
    roads = spark.createDataFrame([*edges, (0, 9000, 0.0), (9000, 1, 0.0), (None, 1, 1.0), (0, 1, None)], "u int, v int, travel_s double")
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(7, 7), (299, 299), (0, 299), (279, 290), (290, 279), (0, 12345), (9000, 9000), (None, 1), (3, 4), (3, 4)]
    asked = spark.createDataFrame(pairs, "src int, dst int")
    want = {(r["src"], r["dst"]): r["cost"] for r in hublabels.costs(asked, hublabels.hub_labels(nodes, roads)).collect()}
    built = []
    monkeypatch.setattr(hublabels, "hub_labels", lambda *a: built.append(a))
    found = route.fastest_paths(asked, reach.Town(nodes, roads)).collect()
    assert {(r["src"], r["dst"]): r["cost"] for r in found} == want and len(found) == len(want) > 50
    assert not built
    cheap = {}
    for u, v, w in edges:
        cheap[u, v] = min(w, cheap.get((u, v), w))
    for r in found:
        assert (r["path"][0], r["path"][-1]) == (r["src"], r["dst"])
        assert sum(cheap[leg] for leg in zip(r["path"], r["path"][1:])) == r["cost"]


def test_many_sources_take_labels(spark, monkeypatch):
    nodes, edges = grid(spark, 8)
    asked = spark.createDataFrame([(1, 20), (5, 60), (9, 9)], "src int, dst int")
    want = sorted(map(tuple, route.fastest_paths(asked, reach.Town(nodes, edges)).collect()))
    monkeypatch.setattr(route, "DIRECT_WORK", 3 * 64 - 1)
    monkeypatch.setattr(route, "_direct_paths", None)
    got = sorted(map(tuple, route.fastest_paths(asked, reach.Town(nodes, edges)).collect()))
    assert [(s, d, round(c, 6), p) for s, d, c, p in got] == [(s, d, round(c, 6), p) for s, d, c, p in want] and len(want) == 3


def test_ties_do_not_depend_on_the_rest_of_the_graph(spark):
    side = 12
    nodes = [(y * side + x, LAT + 0.006 * y, LON + 0.006 * x) for y in range(side) for x in range(side)]
    edges = [(a, b, 660.0, 40.0) for a in range(side * side) for b in (a - 1, a + 1, a - side, a + side) if 0 <= b < side * side and abs(a % side - b % side) < 2]
    nodes, edges = spark.createDataFrame(nodes, "node_id int, lat double, lon double"), route.road_edges(spark.createDataFrame(edges, "u int, v int, len_m double, speed_kmh double"))
    asked = spark.createDataFrame([(13, 52), (52, 13)], "src int, dst int")
    paths = lambda n: {(r["src"], r["dst"]): r["path"] for r in route.fastest_paths(asked, reach.Town(nodes.where(f"node_id < {n}"), edges.where(f"u < {n} AND v < {n}"))).collect()}
    assert paths(144) == paths(60)


def test_batches_share_the_part_of_the_graph(spark):
    nodes, edges = grid(spark, 40)
    shared, seen = reach.Town(nodes, edges, small=0), []

    def ask(pairs):
        asked = spark.createDataFrame(pairs, "src int, dst int")

        def search(some, roads):
            seen.append(sorted(some.inputFiles()))
            return hublabels.paths(asked, hublabels.hub_labels(some, roads))

        got = shared.search(asked, search).collect()
        want = hublabels.paths(asked, hublabels.hub_labels(nodes, edges)).collect()
        assert {(r["src"], r["dst"]): round(r["cost"], 6) for r in got} == {(r["src"], r["dst"]): round(r["cost"], 6) for r in want} and len(got) == len(pairs)

    ask([(41, 205), (3, 120)])
    first = seen[-1]
    ask([(44, 8)])
    assert seen[-1] == first
    ask([(1500, 1420)])  # elsewhere
    assert seen[-1] != first


def test_answers_fill_files(spark, tmp_path, monkeypatch):
    _, base, nodes, edges = streets(spark)
    asked = spark.createDataFrame([(f"VH-00000{v}", n, LAT, LON) for v in (1, 2, 3) for n in range(1, 5)], deviations.REQUEST).repartition(4)
    files = lambda name: len(spark.read.parquet(str(tmp_path / name)).inputFiles())
    deviations.path_sink(spark, str(tmp_path / "one"), base, nodes, edges)(asked, 0)
    assert files("one") == 1 and spark.read.parquet(str(tmp_path / "one")).where("size(lats) > 0").count() == 8
    monkeypatch.setattr(deviations, "FILE_ROWS", 4)
    deviations.path_sink(spark, str(tmp_path / "more"), base, nodes, edges)(asked, 0)
    assert files("more") > 1 and spark.read.parquet(str(tmp_path / "more")).count() == 12
