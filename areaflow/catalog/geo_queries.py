"""Spatial queries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areaflow.catalog.mobility_queries import centres
from areaflow.catalog.views import EVENTS, SQL, R, S, places, query
from areaflow.operators import geo

# --- an irregular 5 x 5 tiling with a hole in the middle area ------------------------------------


def _vertex_sql(i: str, j: str, base: float) -> str:
    shift = f"(CASE WHEN ({i}) BETWEEN 1 AND 4 AND ({j}) BETWEEN 1 AND 4 THEN ((7 * ({i}) + 3 * ({j})) % 5 - 2) / 10.0::DOUBLE ELSE 0.0::DOUBLE END)"
    return f"({base}::DOUBLE + 2 * ({i if base < 0 else j}) + {shift})"


def _edge_rows() -> str:
    corners = [("i", "j"), ("i + 1", "j"), ("i + 1", "j + 1"), ("i", "j + 1")]
    out = []
    for a, b in zip(corners, corners[1:] + corners[:1]):
        out.append(f"SELECT area_id, 0 AS part, {_vertex_sql(*a, -100.0)} AS x1, {_vertex_sql(*a, 25.0)} AS y1, "
                   f"{_vertex_sql(*b, -100.0)} AS x2, {_vertex_sql(*b, 25.0)} AS y2 FROM grid")
    hole = [(-95.33, 29.61), (-94.71, 29.61), (-94.71, 30.37), (-95.33, 30.37)]
    for a, b in zip(hole, hole[1:] + hole[:1]):
        out.append(f"SELECT area_id, 1, {a[0]}::DOUBLE, {a[1]}::DOUBLE, {b[0]}::DOUBLE, {b[1]}::DOUBLE FROM grid WHERE k = 12")
    return " UNION ALL ".join(out)


SQL["grid"] = "SELECT n_nationkey AS k, lpad(CAST(n_nationkey AS VARCHAR), 5, '0') AS area_id, n_nationkey % 5 AS i, n_nationkey // 5 AS j FROM nation"
SQL["poly_edges"] = _edge_rows()


def polygons(s: S) -> DataFrame:
    k = F.col("n_nationkey")

    def vertex(di: int, dj: int) -> Column:
        i, j = k % 5 + di, F.floor(k / 5) + dj
        inner = i.between(1, 4) & j.between(1, 4)
        shift = F.when(inner, ((7 * i + 3 * j) % 5 - 2) / 10.0).otherwise(0.0)
        return F.struct((F.lit(-100.0) + 2 * i + shift).alias("x"), (F.lit(25.0) + 2 * j + shift).alias("y"))

    area = F.lpad(k.cast("string"), 5, "0").alias("area_id")
    shell = s.table("nation").select(area, F.lit(0).alias("part"), F.lit(False).alias("is_hole"),
                                     F.array(vertex(0, 0), vertex(1, 0), vertex(1, 1), vertex(0, 1)).alias("ring"))
    corner = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    hole = s.table("nation").filter(k == 12).select(
        area, F.lit(1).alias("part"), F.lit(True).alias("is_hole"),
        F.array(corner(-95.33, 29.61), corner(-94.71, 29.61), corner(-94.71, 30.37), corner(-95.33, 30.37)).alias("ring"))
    return shell.unionByName(hole)


SQL["points"] = """
SELECT 'p' || place_id AS point_id, lon, lat FROM places
UNION ALL SELECT 'c' || c_custkey, -100.5::DOUBLE + (c_custkey * 37 % 1100) / 100.0::DOUBLE + 0.00317::DOUBLE,
  24.7::DOUBLE + (c_custkey * 53 % 1070) / 100.0::DOUBLE + 0.00291::DOUBLE FROM customer"""


def points(s: S) -> DataFrame:
    k = F.col("c_custkey")
    spots = s.table("customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("point_id"),
        (F.lit(-100.5) + (k * 37 % 1100) / 100.0 + F.lit(0.00317)).alias("lon"),
        (F.lit(24.7) + (k * 53 % 1070) / 100.0 + F.lit(0.00291)).alias("lat"))
    return places(s).select(F.concat(F.lit("p"), "place_id").alias("point_id"), "lon", "lat").unionByName(spots)


SQL["in_poly"] = """
SELECT p.point_id, min(h.area_id) AS area_id FROM points p LEFT JOIN (
  SELECT q.point_id, e.area_id FROM points q CROSS JOIN poly_edges e
  GROUP BY 1, 2 HAVING sum(CASE WHEN (e.y1 > q.lat) <> (e.y2 > q.lat)
                                 AND q.lon < (e.x2 - e.x1) * (q.lat - e.y1) / nullif(e.y2 - e.y1, 0) + e.x1 THEN 1 ELSE 0 END) % 2 = 1) h
  ON h.point_id = p.point_id GROUP BY 1"""


@query("point_in_polygon", "SELECT * FROM in_poly")
def point_in_polygon(s: S):
    return geo.assign_area(points(s), polygons(s), "point_id")


@query("nearest_area", """
SELECT point_id, area_id FROM (SELECT p.point_id, c.area_id, row_number() OVER (PARTITION BY p.point_id
   ORDER BY (p.lon - c.lon) * (p.lon - c.lon) + (p.lat - c.lat) * (p.lat - c.lat), c.area_id) AS rn FROM points p CROSS JOIN centres c) WHERE rn = 1""")
def nearest_area(s: S):
    return geo.nearest_area(points(s), centres(s), "point_id")


_MX = "radians({0}) * 6378137.0::DOUBLE"
_MY = "6378137.0::DOUBLE * ln(tan(0.7853981633974483::DOUBLE + radians({0}) / 2))"
SQL["poly_rings"] = f"""
SELECT area_id, part, sum(x1 * y2 - x2 * y1) / 2 AS a, sum((x1 + x2) * (x1 * y2 - x2 * y1)) / 6 AS cx, sum((y1 + y2) * (x1 * y2 - x2 * y1)) / 6 AS cy,
  sum(u1 * v2 - u2 * v1) / 2 AS ma, sum((u1 + u2) * (u1 * v2 - u2 * v1)) / 6 AS mx, sum((v1 + v2) * (u1 * v2 - u2 * v1)) / 6 AS my
FROM (SELECT area_id, part, x1 + 95 AS x1, y1 - 30 AS y1, x2 + 95 AS x2, y2 - 30 AS y2,
        {_MX.format('x1')} + 10575351.6::DOUBLE AS u1, {_MY.format('y1')} - 3503549.8::DOUBLE AS v1,
        {_MX.format('x2')} + 10575351.6::DOUBLE AS u2, {_MY.format('y2')} - 3503549.8::DOUBLE AS v2 FROM poly_edges) GROUP BY 1, 2"""
SQL["poly_dim"] = """
SELECT area_id, sum(s * cx / a * abs(a)) / sum(s * abs(a)) - 95 AS lon, sum(s * cy / a * abs(a)) / sum(s * abs(a)) + 30 AS lat,
  sum(s * mx / ma * abs(ma)) / sum(s * abs(ma)) - 10575351.6::DOUBLE AS x, sum(s * my / ma * abs(ma)) / sum(s * abs(ma)) + 3503549.8::DOUBLE AS y,
  sum(s * abs(ma)) / 1000000 AS area_km2
FROM (SELECT *, CASE WHEN part = 1 THEN -1 ELSE 1 END AS s FROM poly_rings) GROUP BY 1"""


# Coordinates are compared to the centimetre; the two engines sum in different orders.
@query("polygon_area_centroid", f"""
SELECT area_id, {R('lon')} AS lon, {R('lat')} AS lat, {R('x', 2)} AS x, {R('y', 2)} AS y, {R('area_km2', 3)} AS area_km2 FROM poly_dim""")
def polygon_area_centroid(s: S):
    m = geo.polygon_measures(polygons(s))
    return m.select("area_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), F.round("x", 2).alias("x"),
                    F.round("y", 2).alias("y"), F.round("area_km2", 3).alias("area_km2"))


@query("points_per_area", """
SELECT coalesce(i.area_id, 'none') AS area_id, count(*) AS n FROM events e JOIN in_poly i
  ON i.point_id = 'p' || regexp_extract(e.props, '([0-9]+)', 1) GROUP BY 1""")
def points_per_area(s: S):
    """Distinct places are located once, then joined back to all rows by place id."""
    lookup = geo.assign_area(places(s).select("place_id", "lon", "lat"), polygons(s), "place_id")
    per_place = s.table("events").groupBy(F.regexp_extract("props", r"(\d+)", 1).alias("place_id")).agg(
        F.count("*").alias("n"))
    return per_place.join(lookup, "place_id").groupBy(F.coalesce("area_id", F.lit("none")).alias("area_id")).agg(
        F.sum("n").alias("n"))


# --- exposure: events are observation points of two storms, radii from their values ---------------

_QUADS = ("ne", "se", "sw", "nw")
SQL["track"] = """
SELECT CASE WHEN event_id % 2 = 0 THEN 'Storm A' ELSE 'Storm B' END AS disaster,
  24.0::DOUBLE + (event_id * 13 % 1200) / 100.0::DOUBLE AS lat, -101.0::DOUBLE + (event_id * 29 % 1200) / 100.0::DOUBLE AS lon,
  """ + ", ".join(f"greatest(value / {t} * {f} - 3.0::DOUBLE, 0.0::DOUBLE) AS r{t}_{q}" for t in (34, 50, 64) for q, f in zip(_QUADS, (8, 6, 4, 5))) + """
FROM events"""


def track(s: S, *more: Column) -> DataFrame:
    e = F.col("event_id")
    return s.table("events").select(
        F.when(e % 2 == 0, EVENTS[0].label).otherwise(EVENTS[1].label).alias("disaster"),
        (F.lit(24.0) + (e * 13 % 1200) / 100.0).alias("lat"), (F.lit(-101.0) + (e * 29 % 1200) / 100.0).alias("lon"),
        *[F.greatest(F.col("value") / t * f - 3.0, F.lit(0.0)).alias(f"r{t}_{q}")
          for t in (34, 50, 64) for q, f in zip(_QUADS, (8, 6, 4, 5))], *more)


def _reach(t: int) -> str:
    r = (f"CASE WHEN a.lat >= k.lat AND a.lon >= k.lon THEN r{t}_ne WHEN a.lat < k.lat AND a.lon >= k.lon THEN r{t}_se "
         f"WHEN a.lat < k.lat AND a.lon < k.lon THEN r{t}_sw ELSE r{t}_nw END")
    return f"({r}) > 0 AND km <= ({r}) * 1.852"


@query("exposure_class", f"""
SELECT disaster, area_id, CAST(max(w) AS INTEGER) AS wind_kt FROM (
  SELECT k.disaster, a.area_id, CASE WHEN {_reach(64)} THEN 64 WHEN {_reach(50)} THEN 50 WHEN {_reach(34)} THEN 34 ELSE 0 END AS w
  FROM track k CROSS JOIN points_a a CROSS JOIN LATERAL (SELECT 12742.0::DOUBLE * asin(sqrt(least(1.0, greatest(0.0,
     sin(radians(a.lat - k.lat) / 2) ** 2 + cos(radians(k.lat)) * cos(radians(a.lat)) * sin(radians(a.lon - k.lon) / 2) ** 2)))) AS km) d)
WHERE w > 0 GROUP BY 1, 2""")
def exposure_class(s: S):
    return geo.exposure_class(track(s), points(s).withColumnRenamed("point_id", "area_id"))


SQL["points_a"] = "SELECT point_id AS area_id, lon, lat FROM points"


# --- the same storms, their footprints swept between fixes -----------------------------------------

_RADII = [f"r{t}_{q}" for t in (34, 50, 64) for q in _QUADS]
SQL["legs"] = """
SELECT disaster, """ + ", ".join(f"{c}, coalesce(lead({c}) OVER w, {c}) AS {c}_2" for c in ("lat", "lon", *_RADII)) + """
FROM track_ids WINDOW w AS (PARTITION BY disaster ORDER BY id)"""
SQL["track_ids"] = SQL["track"].replace("SELECT CASE", "SELECT event_id AS id, CASE")


def _swept_reach(t: int) -> str:
    at = lambda c: f"({c} + s * ({c}_2 - {c}))"
    r = (f"CASE WHEN alat >= {at('lat')} AND alon >= {at('lon')} THEN {at(f'r{t}_ne')} WHEN alat < {at('lat')} AND alon >= {at('lon')} THEN {at(f'r{t}_se')} "
         f"WHEN alat < {at('lat')} AND alon < {at('lon')} THEN {at(f'r{t}_sw')} ELSE {at(f'r{t}_nw')} END")
    return f"({r}) > 0 AND km <= ({r}) * 1.852"


@query("exposure_swept", f"""
SELECT disaster, area_id, CAST(max(w) AS INTEGER) AS wind_kt FROM (
  SELECT disaster, area_id, CASE WHEN {_swept_reach(64)} THEN 64 WHEN {_swept_reach(50)} THEN 50 WHEN {_swept_reach(34)} THEN 34 ELSE 0 END AS w
  FROM (SELECT *, 12742.0::DOUBLE * asin(sqrt(least(1.0, greatest(0.0, sin(radians(alat - (lat + s * (lat_2 - lat))) / 2) ** 2
          + cos(radians(lat + s * (lat_2 - lat))) * cos(radians(alat)) * sin(radians(alon - (lon + s * (lon_2 - lon))) / 2) ** 2)))) AS km
    FROM (SELECT *, unnest([0.0::DOUBLE, CASE WHEN dx * dx + dy * dy > 0 THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE,
                ((alon - lon) * c * dx + (alat - lat) * dy) / (dx * dx + dy * dy))) ELSE 0.0::DOUBLE END]) AS s
      FROM (SELECT *, (lon_2 - lon) * c AS dx, lat_2 - lat AS dy FROM (
        SELECT l.*, a.area_id, a.lat AS alat, a.lon AS alon, cos(radians((l.lat + l.lat_2) / 2)) AS c FROM legs l CROSS JOIN points_a a)))))
WHERE w > 0 GROUP BY 1, 2""")
def exposure_swept(s: S):
    moving = track(s, F.col("event_id").alias("t"))
    return geo.exposure_swept(moving, points(s).withColumnRenamed("point_id", "area_id"))


SQL["poly_line"] = "SELECT area_id, (min(least(y1, y2)) + max(greatest(y1, y2))) / 2 AS lat FROM poly_edges GROUP BY 1"


@query("interior_point", f"""
SELECT area_id, {R('(x + x2) / 2')} AS lon, {R('lat')} AS lat FROM (
  SELECT *, row_number() OVER (PARTITION BY area_id ORDER BY x2 - x DESC, x) AS best FROM (
    SELECT area_id, lat, x, lead(x) OVER (PARTITION BY area_id ORDER BY x) AS x2, row_number() OVER (PARTITION BY area_id ORDER BY x) AS k
    FROM (SELECT e.area_id, l.lat, (e.x2 - e.x1) * (l.lat - e.y1) / (e.y2 - e.y1) + e.x1 AS x
          FROM poly_edges e JOIN poly_line l ON l.area_id = e.area_id WHERE (e.y1 > l.lat) <> (e.y2 > l.lat))) WHERE k % 2 = 1) WHERE best = 1""")
def interior_point(s: S):
    p = geo.interior_points(polygons(s))
    return p.select("area_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))
