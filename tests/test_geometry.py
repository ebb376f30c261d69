from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from segpanel.operators import geometry as g
from segpanel.roles import Box
from segpanel.sources.readers import POLYGON, read_geojson

BOX = Box(-10, 10, -10, 10)
SQUARE = [[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0], [0.0, 0.0]]
HOLE = [[1.0, 1.0], [1.0, 2.0], [2.0, 2.0], [1.0, 1.0]]


@pytest.fixture(scope="module")
def features(spark, tmp_path_factory):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"area": "7"}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE, HOLE], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}},
        {"type": "Feature", "properties": {"area": "8"}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE]]}},
    ]}
    path = tmp_path_factory.mktemp("geo") / "areas.geojson"
    path.write_text(json.dumps(doc, indent=1))
    return read_geojson(spark, str(path), ["area"]).cache()


def test_read_and_count(features):
    assert features.count() == 2
    stats = {r["area"]: r for r in g.geometry_stats(g.explode_rings(features, "area"), "area").collect()}
    assert (stats["7"]["polygons"], stats["7"]["rings"], stats["7"]["positions"]) == (2, 3, 13)
    assert (stats["7"]["x_min"], stats["7"]["x_max"], stats["7"]["y_max"]) == (0.0, 6.0, 6.0)
    assert g.explode_positions(g.explode_rings(features, "area"), "area").count() == 18


def test_good_rings(features):
    rows = g.ring_checks(g.explode_rings(features, "area"), "area", BOX).collect()
    assert all(r["valid"] for r in rows)
    assert {r["area_size"] for r in rows} == {16.0, 0.5}


@pytest.mark.parametrize("ring, rule", [
    ([[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]], "enough_positions"),
    ([[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]], "closed"),
    ([[0.0, 0.0], [1.0, 0.0], [0.0, 0.0], [1.0, 0.0], [0.0, 0.0]], "enough_vertices"),
    ([[0.0, 0.0], [1.0, 0.0], [2.0, 0.0], [0.0, 0.0]], "has_area"),
    ([[0.0, 0.0], [11.0, 0.0], [2.0, 3.0], [0.0, 0.0]], "in_bounds"),
    ([[0.0, 0.0], [float("nan"), 0.0], [2.0, 3.0], [0.0, 0.0]], "finite"),
])
def test_each_rule_fails_alone_or_with_others(spark, ring, rule):
    df = spark.createDataFrame([("a", [[ring]])], f"area string, coordinates array<{POLYGON.simpleString()}>")
    row = g.ring_checks(g.explode_rings(df, "area"), "area", BOX).first()
    assert row[rule] is False and row["valid"] is False


def test_rounding_keeps_rings_closed(spark):
    ring = [[0.123456, 0.1], [1.0, 0.0], [1.0, 1.0], [0.123456, 0.1]]
    df = spark.createDataFrame([("a", [[ring]])], f"area string, coordinates array<{POLYGON.simpleString()}>")
    out = g.round_geometry(df, 3).first()["coordinates"][0][0]
    assert out[0] == out[-1] == [0.123, 0.1] and len(out) == 4


def test_join_features(spark, features):
    rows = spark.createDataFrame([("7", 1.0), ("9", 2.0)], "area string, predicted double")
    assert [r["area"] for r in g.join_features(rows, features, "area").select("area").collect()] == ["7"]
    assert features.filter(F.col("geometry_type") == "MultiPolygon").count() == 2
