"""Hub labels against plain searches."""

from __future__ import annotations

import heapq
import math
import random

import pytest

from fleetglass.operators import hublabels, route


def costs_from(edges, src):
    near, cost, heap = {}, {src: 0.0}, [(0.0, src)]
    for u, v, w in edges:
        near.setdefault(u, []).append((v, w))
    while heap:
        d, u = heapq.heappop(heap)
        if d > cost[u]:
            continue
        for v, w in near.get(u, ()):
            if d + w < cost.get(v, math.inf):
                cost[v] = d + w
                heapq.heappush(heap, (d + w, v))
    return cost


def town(seed, n=300):
    """Nodes crowded in one corner, one-way and parallel edges, equal costs, loops, an island and a node without edges."""
    rng = random.Random(seed)
    places = {i: (rng.random() ** 3, rng.random() ** 3) for i in range(n)}
    near = lambda a: sorted(places, key=lambda b: (places[b][0] - places[a][0]) ** 2 + (places[b][1] - places[a][1]) ** 2)[1:5]
    edges = [(a, b, float(rng.randint(0, 4))) for a in range(n - 21) for b in near(a) if b < n - 21]
    edges += [(b, a, w) for a, b, w in edges if rng.random() < 0.5] + [(a, b, w + 1) for a, b, w in edges[:40]] + [(5, 5, 1.0)]
    edges += [(a, a + 1, 1.0) for a in range(n - 21, n - 2)]
    return places, edges


@pytest.mark.parametrize("leaf", [6, 1000])
def test_labels_equal_search(spark, monkeypatch, leaf):
    monkeypatch.setattr(hublabels, "LEAF_NODES", leaf)
    monkeypatch.setattr(hublabels, "BLOCK_ROWS", 50)
    places, edges = town(leaf)
    nodes = spark.createDataFrame([(i, *p) for i, p in places.items()] + [(None, 0.1, 0.1), (9000, None, 0.1)], "node_id int, lat double, lon double")
    roads = spark.createDataFrame([*edges, (0, 9000, 0.0), (9000, 1, 0.0), (None, 1, 1.0), (0, 1, None)], "u int, v int, travel_s double")
    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(7, 7), (299, 299), (0, 299), (279, 290), (290, 279), (0, 12345), (None, 1), (3, 4), (3, 4)]
    asked = spark.createDataFrame(pairs, "src int, dst int")
    labels = hublabels.hub_labels(nodes, roads, of=None if leaf == 6 else asked.selectExpr("explode(array(src, dst)) AS node"))
    want = {(s, d): c for s, d in set(pairs) if s is not None for c in [costs_from(edges, s).get(d)] if c is not None and d in places}
    cheap = {}
    for u, v, w in edges:
        cheap[u, v] = min(w, cheap.get((u, v), math.inf))
    found = hublabels.paths(asked, labels).collect()
    assert {(r["src"], r["dst"]): r["cost"] for r in found} == want
    assert {(r["src"], r["dst"]): r["cost"] for r in hublabels.costs(asked, labels).collect()} == want
    assert len(found) == len(want)
    for r in found:
        assert (r["path"][0], r["path"][-1]) == (r["src"], r["dst"])
        assert sum(cheap[leg] for leg in zip(r["path"], r["path"][1:])) == r["cost"]


def test_labels_of_nothing(spark):
    nodes, roads = spark.createDataFrame([], "node_id int, lat double, lon double"), spark.createDataFrame([], "u int, v int, travel_s double")
    pairs = spark.createDataFrame([(1, 2)], "src int, dst int")
    assert hublabels.paths(pairs, hublabels.hub_labels(nodes, roads)).count() == 0
    some = spark.createDataFrame([(1, 1.0, 1.0), (2, 1.0, 1.0)], nodes.schema)
    assert hublabels.paths(pairs, hublabels.hub_labels(some, roads)).count() == 0
    assert route.label_paths(pairs.limit(0), some, roads).count() == 0
