"""What many rows share is worked out once."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetglass import queries
from fleetglass.operators import normalise, route


def test_places_are_searched_once(spark, monkeypatch):
    asked = []
    whole = route.written

    def counted(df, tag):
        out = whole(df, tag)
        asked.extend([out.count()] if tag == "snap" else [])
        return out

    monkeypatch.setattr(route, "written", counted)
    nodes = spark.createDataFrame([(1, 12.95, 77.58), (2, 12.956, 77.58)], "node_id int, lat double, lon double")
    points = spark.createDataFrame([(k, 12.951 if k % 2 else 12.955, 77.58) for k in range(100)] + [(100, None, 77.58)], "point_id long, lat double, lon double")
    found = {r.point_id: r.node_id for r in route.nearest_nodes(points, nodes).collect()}
    assert found == {k: 1 if k % 2 else 2 for k in range(100)}
    assert max(asked) == 2


def test_a_cell_is_worked_out_once(spark, monkeypatch):
    of = []
    box = queries.geo.pinned
    monkeypatch.setattr(queries.geo, "pinned", lambda df, **made: (of.append((df.count(), df.distinct().count())), box(df, **made))[1])
    rows = queries.geo_cells(spark, "/root/testdata/sf0.001")
    assert rows.count() == queries._events(spark, "/root/testdata/sf0.001").count()
    assert rows.where(F.col("neighbours").isNull()).isEmpty()
    assert of and of[-1][0] == of[-1][1]


def test_masked_samples_parse_what_they_show(spark, monkeypatch):
    parsed, whole = [], normalise.normalise
    monkeypatch.setattr(normalise, "normalise", lambda raw: (parsed.append(raw.count()), whole(raw))[1])
    shown = queries.serve_masked_samples(spark, "/root/testdata/sf0.001").collect()
    all_ = queries._raw(spark, "/root/testdata/sf0.001").count()
    assert shown and parsed == [all_ // 10]
    taken = normalise.as_samples(whole(normalise.sampled(queries._raw(spark, "/root/testdata/sf0.001"), 10)))
    assert sorted(taken.collect()) == sorted(normalise.samples(whole(queries._raw(spark, "/root/testdata/sf0.001")), 10).collect())
