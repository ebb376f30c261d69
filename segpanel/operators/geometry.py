"""Polygon tables: ring tables, validity checks, statistics, rounding. Arrays stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segpanel.functions.expr import dround
from segpanel.roles import Box


def explode_rings(features: DataFrame, key: str, coordinates: str = "coordinates") -> DataFrame:
    """One row per ring with its polygon and ring number. Ring 0 of a polygon is its shell."""
    polygons = features.select(key, F.posexplode(coordinates).alias("polygon_no", "rings"))
    return polygons.select(key, "polygon_no", F.posexplode("rings").alias("ring_no", "ring"))


def explode_positions(rings: DataFrame, key: str) -> DataFrame:
    return rings.select(key, "polygon_no", "ring_no", F.posexplode("ring").alias("position_no", "p")).select(
        key, "polygon_no", "ring_no", "position_no", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y")
    )


def signed_area(ring: Column) -> Column:
    """Shoelace area relative to the ring's first position, which keeps small areas exact."""
    origin = F.get(ring, F.lit(0))
    ox, oy = F.get(origin, F.lit(0)), F.get(origin, F.lit(1))
    pairs = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(ring) - 1, F.lit(1))),
        lambda i: F.struct(F.get(ring, i - 1).alias("a"), F.get(ring, i).alias("b")),
    )

    def cross(p: Column) -> Column:
        ax, ay = F.get(p["a"], F.lit(0)) - ox, F.get(p["a"], F.lit(1)) - oy
        bx, by = F.get(p["b"], F.lit(0)) - ox, F.get(p["b"], F.lit(1)) - oy
        return F.coalesce(ax * by - bx * ay, F.lit(0.0))

    return F.aggregate(F.transform(pairs, cross), F.lit(0.0), lambda acc, v: acc + v) / 2.0


def _finite_position(p: Column) -> Column:
    def ok(v: Column) -> Column:
        return F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))

    return (F.size(p) >= 2) & ok(F.get(p, F.lit(0))) & ok(F.get(p, F.lit(1)))


def ring_checks(rings: DataFrame, key: str, box: Box) -> DataFrame:
    """Every rule a ring must satisfy, as columns."""
    ring = F.col("ring")

    def inside(p: Column) -> Column:
        return F.coalesce(F.get(p, F.lit(0)).between(box.x_min, box.x_max)
                          & F.get(p, F.lit(1)).between(box.y_min, box.y_max), F.lit(False))

    checked = rings.select(
        key, "polygon_no", "ring_no", F.size(ring).cast("bigint").alias("positions"),
        (F.size(ring) >= 4).alias("enough_positions"),
        F.coalesce(F.get(ring, F.lit(0)) == F.get(ring, F.size(ring) - 1), F.lit(False)).alias("closed"),
        (F.size(F.array_distinct(ring)) >= 3).alias("enough_vertices"),
        F.forall(ring, _finite_position).alias("finite"),
        F.forall(ring, inside).alias("in_bounds"),
        F.coalesce(signed_area(ring) != 0, F.lit(False)).alias("has_area"),
        F.abs(signed_area(ring)).alias("area_size"),
    )
    rules = ("enough_positions", "closed", "enough_vertices", "finite", "in_bounds", "has_area")
    ok = F.lit(True)
    for r in rules:
        ok = ok & F.col(r)
    return checked.withColumn("valid", ok)


def geometry_stats(rings: DataFrame, key: str) -> DataFrame:
    """Counts and bounding box per feature from ring-level extremes; positions are not exploded."""
    def extreme(f, axis: int) -> Column:
        return f(F.transform("ring", lambda p: F.get(p, F.lit(axis))))

    per_ring = rings.select(
        key, "polygon_no", F.size("ring").alias("positions"),
        extreme(F.array_min, 0).alias("x0"), extreme(F.array_max, 0).alias("x1"),
        extreme(F.array_min, 1).alias("y0"), extreme(F.array_max, 1).alias("y1"),
    )
    return per_ring.groupBy(key).agg(
        F.countDistinct("polygon_no").alias("polygons"), F.count(F.lit(1)).alias("rings"),
        F.sum("positions").cast("bigint").alias("positions"),
        F.min("x0").alias("x_min"), F.max("x1").alias("x_max"), F.min("y0").alias("y_min"), F.max("y1").alias("y_max"),
    )


def round_geometry(features: DataFrame, digits: int, coordinates: str = "coordinates") -> DataFrame:
    """Round every number; equal first and last positions stay equal, counts do not change."""
    def position(p: Column) -> Column:
        return F.transform(p, lambda v: dround(v, digits))

    rounded = F.transform(coordinates, lambda poly: F.transform(poly, lambda ring: F.transform(ring, position)))
    return features.withColumn(coordinates, rounded)


def join_features(rows: DataFrame, features: DataFrame, key: str = "location_key") -> DataFrame:
    """Rows that have a map feature. Spark broadcasts the features if they are measured small."""
    return rows.join(features, key, "inner")
