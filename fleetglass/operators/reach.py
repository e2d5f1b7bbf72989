"""The part of a road graph that fastest ways between given nodes can run through.

A search over a whole graph grows with the graph, also where all ends lie in one town. So it starts on the nodes of a box
around the ends. No way is faster than the straight line at the graph's highest speed as the crow flies. A way that leaves the
box goes at least from its start to the border and from the border to its end; where that takes longer than the way found
inside, the way found is the fastest of all, and so are its ties. As long as this doesn't hold for every pair, the box is
widened by what is missing, in the end to the whole graph. So no way is lost, also none that makes a wide detour.

A pair without a way inside widens the box up to the whole graph, as only that shows that there is none.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import EARTH_M, haversine_m
from ..sources.shared import discard, written

#: Graphs of up to so many nodes are searched whole.
SMALL_NODES = 4096
#: What the first box adds on each side, of the longest straight line between a pair's ends, and at least in metres.
_WIDER, _LEAST_M = 1.25, 5000.0


def _to_border(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    """Metres from a point inside the box to the nearest point outside, never too many."""
    lat_lo, lat_hi, lon_lo, lon_hi = box
    north_south = F.radians(F.least(lat - lat_lo, lat_hi - lat))
    turn = F.least(F.radians(F.least(lon - lon_lo, lon_hi - lon)), F.lit(math.pi / 2))
    return F.greatest(F.lit(0.0), F.least(north_south, F.asin(F.cos(F.radians(lat)) * F.sin(turn))) * EARTH_M)


def _widened(box: tuple[float, float, float, float], metres: float) -> tuple[float, float, float, float]:
    lat_lo, lat_hi, lon_lo, lon_hi = box
    up = math.degrees(metres / EARTH_M)
    flat = math.cos(math.radians(min(89.0, max(abs(lat_lo), abs(lat_hi)) + up)))
    across = min(360.0, 1.05 * up / flat)
    return lat_lo - up, lat_hi + up, lon_lo - across, lon_hi + across


class Town:
    """A road graph, nodes (node_id, lat, lon) and edges (u, v, travel_s), that is searched once or many times.

    What holds for the whole graph is found out once, and the last search's box stands until ends outside it come or its
    ways might be beaten outside; so a stream's batches share it. Each search proves anew that the box is enough.
    """

    def __init__(self, nodes: DataFrame, edges: DataFrame, small: int = SMALL_NODES) -> None:
        self.nodes, self.edges, self.small = nodes, edges, small
        self.placed = nodes.where("node_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").groupBy("node_id").agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
        self.whole = self.speed = self.box = self.inside = None

    def _at(self, end: str) -> DataFrame:
        # sorted joins: nodes are as many as the graph has, whatever their compressed size tells
        return self.placed.select(F.col("node_id").alias(end), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon")).hint("merge")

    def _fastest(self) -> float:
        """The highest speed as the crow flies on any edge, metres a second."""
        if self.speed is None:
            roads = self.edges.where("u <> v AND travel_s IS NOT NULL").join(self._at("u"), "u").join(self._at("v"), "v")
            flight = haversine_m(F.col("u_lat"), F.col("u_lon"), F.col("v_lat"), F.col("v_lon"))
            self.speed = roads.agg(F.max(F.when(F.col("travel_s") > 0, flight / F.col("travel_s")).when(flight > 0, F.lit(float("inf"))))).first()[0] or 0.0
        return self.speed

    def _part(self, wide: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
        """The nodes of a box and the edges between them."""
        if self.box != wide:
            discard(*(self.inside or ()))
            some = written(self.nodes.where(F.col("lat").between(wide[0], wide[1]) & F.col("lon").between(wide[2], wide[3])), "reach")
            known = some.select("node_id").distinct().hint("merge")
            between = self.edges.join(known.withColumnRenamed("node_id", "u"), "u", "left_semi").join(known.withColumnRenamed("node_id", "v"), "v", "left_semi")
            self.box, self.inside = wide, (some, written(between.select(*self.edges.columns), "reach"))
        return self.inside

    def search(self, pairs: DataFrame, search: Callable[[DataFrame, DataFrame], DataFrame], ends: tuple[str, ...] = ("src", "dst"), keys: tuple[str, ...] = ("src", "dst")) -> DataFrame:
        """What ``search`` gives over nodes and edges, found on as few of them as do.

        ``search`` takes nodes and edges and gives a row with ``cost`` (seconds) for each of the pairs' ``keys`` that has a way.
        """
        if self.whole is None:
            self.whole = tuple(self.placed.agg(F.count("*"), F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first())
        n, *whole = self.whole
        if n <= self.small:
            return search(self.nodes, self.edges)
        asked = pairs.select(*keys).distinct()
        for end in ends:
            asked = asked.join(self._at(end), end)
        asked = written(asked, "asked")
        lats, lons = ([F.col(f"{end}_{c}") for end in ends] for c in ("lat", "lon"))
        low, high = (lambda c: F.least(*c) if len(c) > 1 else c[0]), (lambda c: F.greatest(*c) if len(c) > 1 else c[0])
        straight = haversine_m(lats[0], lons[0], lats[-1], lons[-1])
        *box, longest = asked.agg(F.min(low(lats)), F.max(high(lats)), F.min(low(lons)), F.max(high(lons)), F.max(straight)).first()
        if longest is None:
            return search(self.nodes.limit(0), self.edges.limit(0))
        box, margin = tuple(box), max(_LEAST_M, _WIDER * longest)
        last = self.box if self.box and self.box[0] <= box[0] and self.box[1] >= box[1] and self.box[2] <= box[2] and self.box[3] >= box[3] else None
        while True:
            wide, last = last or _widened(box, margin), None
            if math.isinf(self._fastest()) or (wide[0] <= whole[0] and wide[1] >= whole[1] and wide[2] <= whole[2] and wide[3] >= whole[3]):
                return search(self.nodes, self.edges)
            found = written(search(*self._part(wide)), "ways")
            out = sum((_to_border(lat, lon, wide) for lat, lon in zip(lats, lons, strict=True)), F.lit(0.0))
            missing = F.coalesce(F.col("cost") * (self.speed * (1 + 1e-9)), F.lit(float("inf"))) - out
            short = asked.join(found.select(*keys, "cost"), list(keys), "left").agg(F.max(missing)).first()[0]
            if short < 0:
                return found
            discard(*self.inside, found)
            self.box = self.inside = None
            if wide == _widened(box, margin):
                margin = 4 * margin if math.isinf(short) else margin + short / len(ends) * 1.01 + 1.0


def within_reach(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, search: Callable[[DataFrame, DataFrame], DataFrame], ends: tuple[str, ...] = ("src", "dst"), keys: tuple[str, ...] = ("src", "dst"), small: int = SMALL_NODES) -> DataFrame:
    """A single search of a graph (``Town.search``)."""
    return Town(nodes, edges, small).search(pairs, search, ends, keys)
