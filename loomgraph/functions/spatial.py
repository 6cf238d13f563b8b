"""Points, distances and shapes as expressions.

A point is a struct; WGS-84 points have ``latitude`` and ``longitude``, others ``x``, ``y``
and perhaps ``z``. A polygon is a struct of an array of points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

L = F.lit
EARTH_M = 6_371_000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres along a great circle of the mean earth."""
    dp, dl = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dp / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dl / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(a, L(1.0))))


def geo(a: Column, b: Column) -> Column:
    return haversine(a["latitude"], a["longitude"], b["latitude"], b["longitude"])


def flat(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["x"] - b["x"], 2) + F.pow(a["y"] - b["y"], 2))


def point(m: Column) -> Column:
    return m


def inside(poly: Column, x: Column, y: Column, px: str, py: str) -> Column:
    """Even-odd rule over the polygon's edges; the last point is joined to the first."""
    pts = poly["points"]
    n = F.size(pts)
    cross = F.transform(
        pts,
        lambda p, i: (((p[py] > y) != (F.get(pts, (i + 1) % n)[py] > y)) & (x < F.try_divide((F.get(pts, (i + 1) % n)[px] - p[px]) * (y - p[py]), F.get(pts, (i + 1) % n)[py] - p[py]) + p[px])).cast("int"),
    )
    return F.aggregate(cross, L(0), lambda s, c: s + F.coalesce(c, L(0))) % 2 == 1


def bearing(a: Column, b: Column) -> Column:
    p1, p2, dl = F.radians(a["latitude"]), F.radians(b["latitude"]), F.radians(b["longitude"] - a["longitude"])
    deg = F.degrees(F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)))
    return F.pmod(deg + 360, L(360.0))


def destination(a: Column, metres: Column, degrees: Column) -> Column:
    d, t, p = metres / EARTH_M, F.radians(degrees), F.radians(a["latitude"])
    lat = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t))
    lon = F.radians(a["longitude"]) + F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(lat))
    return F.struct(F.degrees(lat).alias("latitude"), F.degrees(lon).alias("longitude"))


def centroid(pts: Column) -> Column:
    mean = lambda k: F.aggregate(pts, L(0.0), lambda s, p: s + p[k]) / F.size(pts)
    return F.struct(mean("latitude").alias("latitude"), mean("longitude").alias("longitude"))


def area(poly: Column) -> Column:
    """Shoelace, in squared coordinate units."""
    pts = poly["points"]
    n = F.size(pts)
    terms = F.transform(pts, lambda p, i: p["x"] * F.get(pts, (i + 1) % n)["y"] - F.get(pts, (i + 1) % n)["x"] * p["y"])
    return F.abs(F.aggregate(terms, L(0.0), lambda s, t: s + t)) / 2


def bbox(p: Column, lo: Column, hi: Column, px: str, py: str) -> Column:
    return p[px].between(lo[px], hi[px]) & p[py].between(lo[py], hi[py])


def _given(p: Column, name: str) -> Column:
    """A field of a point as text, null where the point has none."""
    return F.get_json_object(F.to_json(p), f"$.{name}")


def srid(p: Column) -> Column:
    """The point's own reference number, else that of its kind of coordinates."""
    return F.coalesce(_given(p, "srid").try_cast("bigint"), F.when(_given(p, "latitude").isNotNull(), L(4326)).otherwise(L(7203)).cast("bigint"))


def crs(p: Column) -> Column:
    kind = F.when(_given(p, "latitude").isNotNull(), F.when(_given(p, "height").isNotNull(), "wgs-84-3d").otherwise("wgs-84"))
    return F.coalesce(_given(p, "crs"), kind, F.when(_given(p, "z").isNotNull(), "cartesian-3d").otherwise("cartesian"))


def kilometres(*a: Column) -> Column:
    """Great-circle distance of two points, or of two latitudes and longitudes, in kilometres."""
    return (geo(*a) if len(a) == 2 else haversine(*a)) / 1000


FUNCTIONS = {
    "point": point,
    "distance": flat, "point.distance": flat, "withinbbox": lambda p, a, b: bbox(p, a, b, "x", "y"), "point.withinbbox": lambda p, a, b: bbox(p, a, b, "x", "y"), "point.withindistance": lambda a, b, r: flat(a, b) <= r,
    "point.x": lambda p: p["x"], "point.y": lambda p: p["y"], "point.z": lambda p: p["z"], "point.latitude": lambda p: p["latitude"], "point.longitude": lambda p: p["longitude"], "point.srid": srid, "point.height": lambda p: p["z"], "point.crs": crs,
    "polygon": lambda pts: F.struct(pts.alias("points")), "linestring": lambda pts: F.struct(pts.alias("points")), "point.contains": lambda g, p: inside(g, p["x"], p["y"], "x", "y"), "point.intersects": lambda p, g: inside(g, p["x"], p["y"], "x", "y"),
}
NAMED = {
    "distance": kilometres, "haversinedistance": kilometres, "vincentydistance": lambda *a: kilometres(*a) * 1000, "bearing": bearing, "destination": lambda p, degrees, metres: destination(p, metres, degrees), "midpoint": lambda a, b: destination(a, geo(a, b) / 2, bearing(a, b)), "centroid": centroid, "area": area,
    "within": lambda p, box: p["latitude"].between(box["minLat"], box["maxLat"]) & p["longitude"].between(box["minLon"], box["maxLon"]), "withindistance": lambda a, pts, r: F.filter(pts, lambda p: kilometres(a, p) <= r), "contains": lambda g, p: inside(g, p["x"], p["y"], "x", "y"), "intersects": lambda g, p: inside(g, p["x"], p["y"], "x", "y"),
    "boundingbox": lambda pts: F.struct(F.array_min(F.transform(pts, lambda p: p["latitude"])).alias("minLat"), F.array_max(F.transform(pts, lambda p: p["latitude"])).alias("maxLat"), F.array_min(F.transform(pts, lambda p: p["longitude"])).alias("minLon"), F.array_max(F.transform(pts, lambda p: p["longitude"])).alias("maxLon")),
    "nearest": lambda p, pts: F.array_min(F.transform(pts, lambda r: F.struct(geo(p, r).alias("d"), r.alias("p"))))["p"], "knearest": lambda p, pts, k: F.transform(F.slice(F.array_sort(F.transform(pts, lambda r: F.struct(geo(p, r).alias("d"), r.alias("p")))), L(1), k.cast("int")), lambda s: s["p"]),
    "togeojson": lambda p: F.to_json(F.struct(L("Point").alias("type"), F.array(p["longitude"], p["latitude"]).alias("coordinates"))), "fromgeojson": lambda s: F.struct(F.get_json_object(s, "$.coordinates[1]").cast("double").alias("latitude"), F.get_json_object(s, "$.coordinates[0]").cast("double").alias("longitude")),
}
