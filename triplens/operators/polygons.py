"""Zone polygons from their text: rings as arrays, area, box and centroid.

Shapes are WKT, ``POLYGON`` or ``MULTIPOLYGON``, on one line or several. They become arrays of parts, of rings (the
first is the outer one, the others are holes) and of points, by built-in functions alone. Lengths are in the units of the
coordinates.

Defined results: a null or malformed shape has null parts and figures; an empty one has no parts, area 0 and no box or
centroid; a shape without area has no centroid. Rings may be given with or without their first point again at
the end, and in either direction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NUMBER = r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?"
_POINT = rf"\s*{_NUMBER}\s+{_NUMBER}\s*"
_RING = rf"\s*\({_POINT}(,{_POINT})*\)\s*"
_PART = rf"\s*\({_RING}(,{_RING})*\)\s*"
_SHAPE = rf"(?i)^\s*(POLYGON{_PART}|MULTIPOLYGON\s*\({_PART}(,{_PART})*\)\s*)$"
_EMPTY = r"(?i)^\s*(MULTI)?POLYGON\s+EMPTY\s*$"


def parts(shape: Column) -> Column:
    """array<array<array<struct<x, y>>>>: the parts of a shape, their rings, and the rings' points."""
    text = F.regexp_replace(shape, r"\s+", " ")
    body = F.regexp_replace(F.regexp_replace(text, r"^[^(]*[( ]*", ""), r"[) ]*$", "")

    def point(p: Column) -> Column:
        xy = F.split(F.trim(p), " ")
        return F.struct(F.get(xy, F.lit(0)).cast("double").alias("x"), F.get(xy, F.lit(1)).cast("double").alias("y"))

    rings = F.transform(
        F.split(body, r"\) ?\) ?, ?\( ?\("),
        lambda part: F.transform(F.split(part, r"\) ?, ?\("), lambda ring: F.transform(F.split(ring, ","), point)),
    )
    return F.when(F.rlike(shape, F.lit(_EMPTY)), F.expr("cast(array() as array<array<array<struct<x: double, y: double>>>>)")).when(F.rlike(shape, F.lit(_SHAPE)), rings)


def _moments(ring: Column) -> Column:
    """(a, mx, my) of a ring: its area, and that times its centroid; the same for both directions."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    edges = F.zip_with(ring, after, lambda p, q: F.struct((p.x * q.y - q.x * p.y).alias("c"), (p.x + q.x).alias("sx"), (p.y + q.y).alias("sy")))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))
    found = F.aggregate(edges, zero, lambda s, e: F.struct((s.a + e.c / 2).alias("a"), (s.mx + e.c * e.sx / 6).alias("mx"), (s.my + e.c * e.sy / 6).alias("my")))
    return F.transform(F.array(found), lambda s: F.struct(F.abs(s.a).alias("a"), (F.signum(s.a) * s.mx).alias("mx"), (F.signum(s.a) * s.my).alias("my")))[0]


def zone_polygons(shapes: DataFrame, key: str = "LocationID", shape: str = "shape") -> DataFrame:
    """(key, parts, n_parts, n_holes, n_points, area, centroid_x, centroid_y, min_x, min_y, max_x, max_y) of every zone."""
    rows = shapes.select(F.col(key), parts(F.col(shape)).alias("parts"))
    # Holes count against the rings around them.
    signed = F.flatten(F.transform("parts", lambda p: F.transform(p, lambda r, i: F.struct(F.when(i == 0, 1.0).otherwise(-1.0).alias("sign"), _moments(r).alias("m")))))
    points = F.flatten(F.flatten("parts"))
    rows = rows.select(key, "parts", signed.alias("rings"), points.alias("points"))

    def total(name: str) -> Column:
        return F.aggregate("rings", F.lit(0.0), lambda s, r: s + r.sign * r.m[name])

    area = total("a")
    return rows.select(
        key,
        "parts",
        F.when(F.col("parts").isNotNull(), F.size("parts")).alias("n_parts"),
        F.when(F.col("parts").isNotNull(), F.size("rings") - F.size("parts")).alias("n_holes"),
        F.when(F.col("parts").isNotNull(), F.size("points")).alias("n_points"),
        area.alias("area"),
        F.try_divide(total("mx"), F.nullif(area, F.lit(0.0))).alias("centroid_x"),
        F.try_divide(total("my"), F.nullif(area, F.lit(0.0))).alias("centroid_y"),
        *[f(F.col("points")[c]).alias(f"{n}_{c}") for n, f in (("min", F.array_min), ("max", F.array_max)) for c in ("x", "y")],
    )
