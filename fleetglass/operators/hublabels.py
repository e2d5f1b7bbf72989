"""Fastest paths from labels that are built once for a road graph (2-hop labels over nested districts).

Nodes are halved at their median longitude and latitude in turn, so every district of a level holds about as many nodes as
any other, however dense its roads; four districts make one of the next level. Bottom up, each district's shortest ways
between the nodes that have edges out of it are found from those of its four parts and the edges between the parts. Every
edge between two parts has one end among the district's hubs.

A fastest way that stays in a district but not in one of its parts runs through one of its hubs. So a node's label, its
ways to and from the hubs of the districts around it, answers any pair: the cheapest sum over the hubs of the districts
that both ends lie in. That is one join on each side and no search. The nodes between are read off the districts' tables of
next hops, level by level: as many steps as there are levels, whatever the length of the ways.

A district's table has the nodes on its parts' borders squared, about the number of its nodes on a grid, less on real
roads. Nodes without place and edges to them play no part; parallel edges count with the fastest; an edge from a node to
itself is never on a way; costs must not be negative. Pairs without a way, or with a node that is not in the graph, give no
row; a node's way to itself is the node alone. Empty tables give no rows.
"""

from __future__ import annotations

import dataclasses
import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import discard, written

LEAF_NODES = 64
#: Rows of a district that one task takes; a district with more is dealt over several.
BLOCK_ROWS = 4096
_SOLVED = "cell long, ids array<long>, parts array<long>, border array<int>, hubs array<long>, cost binary, hop binary"
_LABEL = "node long, level int, cell long, offset int, n_hubs int, to binary, to_via binary, back binary, back_via binary"
_LEG = "ord array<int>, level int, cell long, from_kind int, from_at int, to_kind int, to_at int, node long"
#: What a leg's end counts: the district's nodes, its hubs, or the nodes on its border.
_ANY, _HUB, _BORDER = 0, 1, 2


@dataclasses.dataclass(frozen=True)
class HubLabels:
    """The districts' tables, from the smallest to the whole graph, and the labels of the nodes that may be asked for."""

    districts: list[DataFrame]
    labels: DataFrame


def _placed(nodes: DataFrame, levels: int) -> DataFrame:
    """node and cell, its smallest district: two bits a level, the highest for the widest."""
    now = nodes.where("node_id IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL").groupBy(F.col("node_id").cast("long").alias("node")).agg(F.min("lat").alias("lat"), F.min("lon").alias("lon"))
    now = now.withColumn("cell", F.lit(0).cast("long"))
    for _ in range(levels):
        for axis in ("lon", "lat"):
            middle = now.groupBy("cell").agg(F.percentile_approx(axis, 0.5, 1000).alias("_middle"))
            now = now.join(middle, "cell").select("node", "lat", "lon", (F.col("cell") * 2 + (F.col(axis) > F.col("_middle")).cast("long")).alias("cell"))
        last, now = now, written(now, "districts")
        discard(last)
    return now.select("node", "cell")


def _crossing(placed: DataFrame, edges: DataFrame, levels: int) -> DataFrame:
    """u, v, w, the cells of both, and the level of the smallest district that holds both."""
    best = edges.where("u <> v AND travel_s IS NOT NULL").groupBy(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).agg(F.min("travel_s").alias("w"))
    ends = best.join(placed.select(F.col("node").alias("u"), F.col("cell").alias("cu")).hint("merge"), "u").join(placed.select(F.col("node").alias("v"), F.col("cell").alias("cv")).hint("merge"), "v")
    apart = [F.when(F.shiftright("cu", 2 * n) != F.shiftright("cv", 2 * n), 1).otherwise(0) for n in range(levels)]
    return ends.withColumn("level", functools.reduce(lambda a, b: a + b, apart, F.lit(0)).cast("int"))


def _start(placed: DataFrame, roads: DataFrame) -> DataFrame:
    """Each node as a district of its own, with the level up to which its edges lead out and the levels at which it is a hub."""
    below = F.when(F.col("level") > 0, F.expr("shiftright(cu, 2 * (level - 1)) < shiftright(cv, 2 * (level - 1))")).otherwise(False)
    ends = F.array(F.struct(F.col("u").alias("node"), below.alias("hub")), F.struct(F.col("v").alias("node"), ((F.col("level") > 0) & ~below).alias("hub")))
    facts = roads.select("level", F.explode(ends).alias("e")).groupBy("e.node").agg(F.max("level").alias("border"), F.bit_or(F.when(F.col("e.hub"), F.expr("shiftleft(1L, level)")).otherwise(F.lit(0).cast("long"))).alias("hubs"))
    full = placed.join(facts, "node", "left").select("node", "cell", F.coalesce("border", F.lit(0)).alias("border"), F.coalesce("hubs", F.lit(0).cast("long")).alias("hubs"))
    # every node of a smallest district is one of its hubs
    one = F.array("node"), F.array("node"), F.array("border"), F.array(F.col("hubs").bitwiseOR(F.lit(1).cast("long")))
    return full.select(F.col("node").alias("part"), "cell", one[0].alias("ids"), one[2].alias("border"), one[3].alias("hubs"), F.unhex(F.lit("00" * 8)).alias("cost"))


def _solve(level: int):
    """The shortest ways inside a district between the border nodes of its parts."""

    def run(parts: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        if not len(parts):
            return pd.DataFrame(columns=[c.split()[0] for c in _SOLVED.split(", ")])
        ids, of, border, hubs, blocks = [], [], [], [], []
        for row in parts.sort_values("part").itertuples(index=False):
            out = np.asarray(row.border) >= level
            blocks.append(np.frombuffer(row.cost).reshape(len(out), len(out))[np.ix_(out, out)])
            ids.append(np.asarray(row.ids, dtype=np.int64)[out])
            of.append(np.full(len(ids[-1]), row.part, dtype=np.int64))
            border.append(np.asarray(row.border, dtype=np.int32)[out])
            hubs.append(np.asarray(row.hubs, dtype=np.int64)[out])
        ids, of, border, hubs = (np.concatenate(x) for x in (ids, of, border, hubs))
        n, at = len(ids), 0
        cost = np.full((n, n), np.inf)
        for block in blocks:
            cost[at : at + len(block), at : at + len(block)] = block
            at += len(block)
        order = np.argsort(ids)
        if len(edges):
            u, v = (order[np.searchsorted(ids[order], edges[c].to_numpy())] for c in ("u", "v"))
            cost[u, v] = edges["w"].to_numpy()
        hop = np.where(np.isfinite(cost), np.arange(n, dtype=np.int32), np.int32(-1)).astype(np.int32)
        for k in range(n):
            way = cost[:, k, None] + cost[None, k]
            better = way < cost
            np.copyto(cost, way, where=better)
            np.copyto(hop, np.broadcast_to(hop[:, k, None], hop.shape), where=better)
        cell = parts["cell"].iloc[0]
        return pd.DataFrame({"cell": [cell], "ids": [ids], "parts": [of], "border": [border], "hubs": [hubs], "cost": [cost.tobytes()], "hop": [hop.tobytes()]})

    return run


def _ends(district: pd.Series, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the hubs and the border nodes of a district stand among its nodes."""
    hubs = (np.asarray(district["hubs"], dtype=np.int64) >> level) & 1
    return np.flatnonzero(hubs == 1), np.flatnonzero(np.asarray(district["border"], dtype=np.int32) > level)


def _extend(level: int):
    """A level's labels from those of the level below: by way of the border of a node's part to hubs and the wider border."""

    def through(ways: np.ndarray, on: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        best, via = np.full((len(ways), on.shape[1]), np.inf), np.zeros((len(ways), on.shape[1]), dtype=np.int32)
        for k in range(on.shape[0]):
            way = ways[:, k, None] + on[k]
            better = way < best
            np.copyto(best, way, where=better)
            via[better] = k
        return best, via

    def run(labels: pd.DataFrame, districts: pd.DataFrame) -> pd.DataFrame:
        out = []
        for district in districts.to_dict("records") if len(labels) else []:
            hubs, border = _ends(district, level)
            ends, of = np.concatenate([hubs, border]), np.asarray(district["parts"], dtype=np.int64)
            cost = np.frombuffer(district["cost"]).reshape(len(of), len(of))
            for part, rows in labels.groupby("part"):
                mine = np.flatnonzero(of == part)
                to, back = (np.stack([np.frombuffer(x)[n:] for x, n in zip(rows[c], rows["n_hubs"], strict=True)]) for c in ("to", "back"))
                to, to_via = through(to, cost[np.ix_(mine, ends)])
                back, back_via = through(back, cost[np.ix_(ends, mine)].T)
                offset = int(mine[0]) if len(mine) else 0
                for i, node in enumerate(rows["node"]):
                    out.append((node, level, district["cell"], offset, len(hubs), to[i].tobytes(), to_via[i].tobytes(), back[i].tobytes(), back_via[i].tobytes()))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _LABEL.split(", ")])

    return run


def _dealt(rows: DataFrame, districts: DataFrame, *spread: str) -> tuple[DataFrame, DataFrame]:
    """Rows and districts with ``block``: a district's rows in blocks of about ``BLOCK_ROWS``, and the district once for each."""
    blocks = rows.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("_n"))
    dealt = rows.join(blocks, "cell").withColumn("block", F.pmod(F.xxhash64(*spread), F.col("_n")).cast("int")).drop("_n")
    return dealt, districts.join(blocks, "cell").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")


def hub_labels(nodes: DataFrame, edges: DataFrame, of: DataFrame | None = None) -> HubLabels:
    """Labels over nodes (node_id, lat, lon) and edges (u, v, travel_s), of all nodes or of those in ``of`` (node) alone."""
    levels = max(0, math.ceil(math.log(max(1, nodes.count()) / LEAF_NODES, 4)))
    placed = _placed(nodes, levels)
    roads = written(_crossing(placed, edges, levels), "roads")
    districts, made = [], []
    parts = written(_start(placed, roads), "parts")
    asked = placed if of is None else placed.join(of.select(F.col("node").cast("long").alias("node")).distinct(), "node", "left_semi")
    zero = F.unhex(F.lit("00" * 8))
    now = asked.select("node", F.col("node").alias("part"), "cell", F.lit(0).alias("n_hubs"), zero.alias("to"), zero.alias("back"))
    for level in range(levels + 1):
        between = roads.where(F.col("level") == level).select(F.shiftright("cu", 2 * level).alias("cell"), "u", "v", "w")
        solved = written(parts.groupBy("cell").cogroup(between.groupBy("cell")).applyInPandas(_solve(level), _SOLVED), "district")
        districts.append(solved)
        rows, tables = _dealt(now, solved.drop("ids", "hop"), "node")
        made.append(written(rows.groupBy("cell", "block").cogroup(tables.groupBy("cell", "block")).applyInPandas(_extend(level), _LABEL), "labels"))
        up = F.shiftright("cell", 2).alias("cell")
        parts = solved.select(F.col("cell").alias("part"), up, "ids", "border", "hubs", "cost")
        now = made[-1].select("node", F.col("cell").alias("part"), up, "n_hubs", "to", "back")
    return HubLabels(districts, functools.reduce(DataFrame.unionByName, made))


def _met(side: str) -> list[str]:
    return ["level", "cell", "offset", "n_hubs", side, f"{side}_via"]


def _meeting(with_legs: bool):
    """The cheapest hub of each pair, and the legs of the way by it."""

    def chain(label: list, side: str, top: int, hub: int) -> list[tuple]:
        """The legs of one side, from the node up: level, cell, place on the lower border, kind and place of the upper end."""
        legs, kind, at = [], _HUB, hub
        for level in range(top, -1, -1):
            here = label[level]
            via = int(np.frombuffer(here[f"{side}_via"], dtype=np.int32)[at + (here["n_hubs"] if kind == _BORDER else 0)])
            legs.append((level, here["cell"], here["offset"] + via, kind, at))
            kind, at = _BORDER, via
        return legs[::-1]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for src, dst, a, b in zip(frame["src"], frame["dst"], frame["a"], frame["b"], strict=True):
                best = (np.inf, 0, 0)
                for level, (x, y) in enumerate(zip(a, b, strict=True)):
                    if x["cell"] == y["cell"] and x["n_hubs"]:
                        ways = np.frombuffer(x["to"])[: x["n_hubs"]] + np.frombuffer(y["back"])[: x["n_hubs"]]
                        hub = int(ways.argmin())
                        best = min(best, (float(ways[hub]), level, hub))
                cost, top, hub = best
                if cost == np.inf:
                    continue
                legs = []
                if with_legs:
                    up = [(level, cell, _ANY, low, kind, at) for level, cell, low, kind, at in chain(a, "to", top, hub)]
                    down = [(level, cell, kind, at, _ANY, low) for level, cell, low, kind, at in reversed(chain(b, "back", top, hub))]
                    legs = [([n], *leg, None) for n, leg in enumerate(up + down)]
                out.append((src, dst, cost, legs))
            yield pd.DataFrame(out, columns=["src", "dst", "cost", "legs"])

    return run


def _unfold(level: int):
    """A district's legs, cut at its parts' borders: legs of the parts, and nodes where an edge between parts is taken."""

    def run(legs: pd.DataFrame, districts: pd.DataFrame) -> pd.DataFrame:
        out = []
        for district in districts.to_dict("records") if len(legs) else []:
            hubs, border = _ends(district, level)
            ids, of = np.asarray(district["ids"]), np.asarray(district["parts"])
            hop = np.frombuffer(district["hop"], dtype=np.int32).reshape(len(of), len(of))
            first = np.searchsorted(of, of)
            place = (np.arange(len(of)), hubs, border)
            for leg in legs.itertuples(index=False):
                here, there, n = int(place[leg.from_kind][leg.from_at]), int(place[leg.to_kind][leg.to_at]), 0
                while here != there:
                    step = int(hop[here, there])
                    if of[here] == of[step]:
                        row = (level - 1, int(of[here]), _BORDER, int(here - first[here]), _BORDER, int(step - first[step]), None)
                    else:
                        row = (-1, None, None, None, None, None, int(ids[step]))
                    out.append((leg.src, leg.dst, [*leg.ord, n], *row))
                    here, n = step, n + 1
        return pd.DataFrame(out, columns=["src", "dst", *[c.split()[0] for c in _LEG.split(", ")]]).astype({"level": "Int32", "cell": "Int64", "from_kind": "Int32", "from_at": "Int32", "to_kind": "Int32", "to_at": "Int32", "node": "Int64"})

    return run


def _paired(pairs: DataFrame, labels: HubLabels, with_legs: bool) -> DataFrame:
    wanted = pairs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct()
    whole = lambda side, key, name: labels.labels.groupBy(F.col("node").alias(key)).agg(F.array_sort(F.collect_list(F.struct(*_met(side)))).alias(name))
    met = wanted.join(whole("to", "src", "a"), "src").join(whole("back", "dst", "b"), "dst")
    legs = _LEG.replace(", ", ",").replace(" ", ":")
    return met.mapInPandas(_meeting(with_legs), f"src long, dst long, cost double, legs array<struct<{legs}>>")


def costs(pairs: DataFrame, labels: HubLabels) -> DataFrame:
    """src, dst and cost of the fastest way of each pair: a join on each side and a minimum."""
    return _paired(pairs, labels, with_legs=False).select("src", "dst", "cost")


def paths(pairs: DataFrame, labels: HubLabels) -> DataFrame:
    """src, dst, cost and path (nodes) of the fastest way of each pair."""
    found = written(_paired(pairs, labels, with_legs=True), "pairs")
    open_ = found.select("src", "dst", F.inline("legs"))
    nodes = []
    for level in range(len(labels.districts) - 1, -1, -1):
        legs, tables = _dealt(open_.where(F.col("level") == level), labels.districts[level].drop("cost"), "src", "dst")
        cut = legs.groupBy("cell", "block").cogroup(tables.groupBy("cell", "block")).applyInPandas(_unfold(level), f"src long, dst long, {_LEG}")
        cut = written(cut, "legs")
        nodes.append(cut.where("node IS NOT NULL"))
        open_ = open_.where(F.col("level") < level).unionByName(cut.where("node IS NULL"))
    steps = functools.reduce(DataFrame.unionByName, nodes).groupBy("src", "dst").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "node"))), lambda x: x["node"]).alias("_steps"))
    path = F.concat(F.array("src"), F.coalesce("_steps", F.array().cast("array<long>")))
    return found.select("src", "dst", "cost").join(steps, ["src", "dst"], "left").select("src", "dst", "cost", path.alias("path"))
