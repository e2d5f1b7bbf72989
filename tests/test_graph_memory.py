"""Searches hold no whole graph in the driver and work nothing out of all edges anew in each round."""

from __future__ import annotations

from fleetglass import queries
from fleetglass.operators import route


def test_edges_of_the_grid_are_joined_once_and_without_a_broadcast(spark):
    plan = spark._jsparkSession.sharedState().statusStore()
    before = plan.executionsCount()
    _, edges, speeds = queries._graph(spark, "/root/testdata/sf0.01")
    assert "Join" not in edges._jdf.queryExecution().optimizedPlan().toString()
    assert "BroadcastHashJoin" not in speeds._jdf.queryExecution().executedPlan().toString()
    made = plan.executionsList(before, 100)
    assert not any("BroadcastHashJoin" in made.apply(i).physicalPlanDescription() for i in range(made.size()))


def test_the_highest_speed_is_worked_out_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            seen.add(len(frame))
            yield frame

    side = 3 * route.HOPS
    nodes = spark.createDataFrame([(i, 12.95, 77.58 + 0.006 * i) for i in range(side)], "node_id int, lat double, lon double")
    edges = spark.createDataFrame([(i, i + 1, 660.0, 40.0) for i in range(side - 1)], "u int, v int, len_m double, speed_kmh double")
    speeds = route.fastest_mps(edges).mapInPandas(counted, "max_mps double")
    pairs = spark.createDataFrame([(0, side - 1)], "src int, dst int")
    found = route.shortest_paths(pairs, nodes, route.road_edges(edges), speeds).collect()
    assert [(r["src"], r["dst"], r["path"]) for r in found] == [(0, side - 1, list(range(side)))]
    assert seen.value == 1
