"""Which zone contains a coordinate.

Zones are hashed into square cells.  A zone uses cells at least as wide as itself, so it touches at most four
of them whatever its size; points look up their cell once per cell width in use.  The join is an equi-join on
the cell, followed by the exact test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def inside_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point against a ring of struct<x, y> (closed or not)."""
    shifted = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    edges = F.arrays_zip(ring.alias("a"), shifted.alias("b"))

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["y"] > y) != (b["y"] > y)
        at = a["x"] + F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"])
        return spans & (x < at)

    return F.size(F.filter(edges, crosses)) % 2 == 1


def with_bounds(zones: DataFrame, ring: str = "ring") -> DataFrame:
    """Add the bounding box columns of a ring."""
    return zones.withColumns(
        {
            f"{end}_{axis}": (F.array_min if end == "min" else F.array_max)(F.transform(ring, lambda p: p[axis]))
            for axis in ("x", "y")
            for end in ("min", "max")
        }
    )


def point_in_zone(
    points: DataFrame,
    zones: DataFrame,
    *,
    point_id: str,
    x: str = "longitude",
    y: str = "latitude",
    zone: str = "zone",
    into: str = "zone",
    base_cell: float | None = None,
) -> DataFrame:
    """Points with the zone that contains them (the smallest name where zones overlap), NULL when none does.

    ``zones`` has ``zone, min_x, max_x, min_y, max_y`` and optionally ``ring``; without it the box is the zone,
    its lower edges included.
    """
    extent = F.greatest(F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y"))
    if base_cell is None:
        base_cell = zones.agg(F.percentile_approx(F.when(extent > 0, extent), 0.5)).first()[0] or 1.0
    level = F.greatest(F.ceil(F.log2(F.greatest(extent, F.lit(1e-12)) / base_cell)), F.lit(0)).cast("int")
    levels = [r[0] for r in zones.select(level.alias("level")).distinct().collect()]  # a few dozen at most

    def cell(c: Column, width: Column) -> Column:
        return F.floor(c / width).cast("long")

    width = F.lit(base_cell) * F.pow(F.lit(2.0), F.col("level"))
    ring = [F.col("ring")] if "ring" in zones.columns else []
    indexed = (
        zones.select(F.col(zone).alias("_zone"), "min_x", "max_x", "min_y", "max_y", *ring, level.alias("level"))
        .withColumn("cell_x", F.explode(F.sequence(cell(F.col("min_x"), width), cell(F.col("max_x"), width))))
        .withColumn("cell_y", F.explode(F.sequence(cell(F.col("min_y"), width), cell(F.col("max_y"), width))))
    )
    px, py = F.col("_x"), F.col("_y")
    probes = (
        points.select(F.col(point_id), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
        .filter(px.isNotNull() & py.isNotNull())
        .withColumn("level", F.explode(F.array(*[F.lit(v) for v in levels])))
        .withColumns({"cell_x": cell(px, width), "cell_y": cell(py, width)})
    )
    in_box = (px >= F.col("min_x")) & (py >= F.col("min_y"))
    if ring:
        hit = in_box & (px <= F.col("max_x")) & (py <= F.col("max_y")) & inside_ring(px, py, F.col("ring"))
    else:
        hit = in_box & (px < F.col("max_x")) & (py < F.col("max_y"))
    found = (
        probes.join(indexed, ["level", "cell_x", "cell_y"])
        .filter(hit)
        .groupBy(point_id)
        .agg(F.min("_zone").alias(into))
    )
    return points.join(found, point_id, "left")


def assign_zone(
    facilities: DataFrame,
    known_zones: DataFrame,
    polygons: DataFrame,
    *,
    facility_id: str = "facility_id",
    zip_code: str = "zip_code",
    x: str = "longitude",
    y: str = "latitude",
) -> DataFrame:
    """``census_zcta`` and how it was found: the zip itself when it is a known zone, else the zone around the
    coordinate, else unresolved."""
    known = known_zones.select(F.col("zcta").alias(zip_code)).distinct().withColumn("_known", F.lit(True))
    flagged = facilities.join(known, zip_code, "left")
    rest = flagged.filter(F.col("_known").isNull())
    located = point_in_zone(rest, polygons, point_id=facility_id, x=x, y=y, into="_point_zone").select(
        facility_id, "_point_zone"
    )
    by_zip = F.col("_known").isNotNull()
    method = (
        F.when(by_zip, "zip_exact").when(F.col("_point_zone").isNotNull(), "coordinate_point").otherwise("unresolved")
    )
    return (
        flagged.join(located, facility_id, "left")
        .withColumn("census_zcta", F.when(by_zip, F.col(zip_code)).otherwise(F.col("_point_zone")))
        .withColumn("zcta_match_method", method)
        .drop("_known", "_point_zone")
    )
