"""Spatial joins as tile-keyed equi-joins: point in polygon, nearest centre, exposure by radius.

No step compares all points with all areas. Points and areas are cut into square tiles,
matched on the tile, and refined with the exact predicate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from areaflow.functions.columns import EARTH_RADIUS_KM, haversine_km, mercator_x, mercator_y
from areaflow.functions.frames import spread
from areaflow.sources.staging import staged


def tile(c: str | Column, size: float) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c / F.lit(float(size)))


# --- polygons ------------------------------------------------------------------

def ring_edges(polygons: DataFrame, keep: Sequence[str] = ("area_id", "part")) -> DataFrame:
    """Edges of each ring as an array of ``(x1, y1, x2, y2)``; open rings are closed.

    ``polygons``: ``area_id``, ``part``, ``ring`` (array of ``x``, ``y``). Holes are further parts.
    """
    closed = F.when(F.element_at("ring", 1) == F.element_at("ring", -1), F.col("ring")).otherwise(
        F.concat("ring", F.slice("ring", 1, 1)))
    pairs = F.zip_with(
        F.slice("_r", F.lit(1), F.size("_r") - 1), F.slice("_r", F.lit(2), F.size("_r") - 1),
        lambda a, b: F.struct(a["x"].alias("x1"), a["y"].alias("y1"), b["x"].alias("x2"), b["y"].alias("y2")))
    return polygons.filter(F.size("ring") >= 3).withColumn("_r", closed).select(*keep, pairs.alias("edges"))


# How far a cell's reference point lies from its corner, in parts of its side. No round number, so that vertices
# given in round numbers hardly ever lie on a line through it.
_REF = (0.3819660112501051, 0.6180339887498949)


# Predicates on the edges ``e`` of an array, as SQL text: nested lambdas are built once by the parser.

def _turn(x: str, y: str) -> str:
    """Positive on the left of an edge, negative on its right."""
    return f"((e.x2 - e.x1) * ({y} - e.y1) - (e.y2 - e.y1) * ({x} - e.x1))"


def _crossings(rx: str, ry: str, px: str, py: str) -> str:
    """How many edges the segment from (rx, ry) to (px, py) crosses; a vertex counts to one side of its line."""
    over = lambda x, y: f"(({px} - {rx}) * ({y} - {ry}) - ({py} - {ry}) * ({x} - {rx}) > 0)"
    return (f"size(filter(edges, e -> {over('e.x1', 'e.y1')} != {over('e.x2', 'e.y2')} "
            f"AND ({_turn(rx, ry)} > 0) != ({_turn(px, py)} > 0)))")


def _touching(ix: str, iy: str, side: str) -> str:
    """The edges that touch a closed square cell; one that only comes close may stay."""
    cx, cy, reach = f"(({ix} + 0.5D) * {side})", f"(({iy} + 0.5D) * {side})", f"({side} * {0.5 * (1 + 1e-9)!r}D)"
    return (f"filter(edges, e -> greatest(e.x1, e.x2) >= {cx} - {reach} AND least(e.x1, e.x2) <= {cx} + {reach} "
            f"AND greatest(e.y1, e.y2) >= {cy} - {reach} AND least(e.y1, e.y2) <= {cy} + {reach} "
            f"AND abs({_turn(cx, cy)}) <= (abs(e.x2 - e.x1) + abs(e.y2 - e.y1)) * {reach})")


def _reference(ix: str, iy: str, side: str) -> tuple[str, str]:
    return f"(({ix} + {_REF[0]!r}D) * {side})", f"(({iy} + {_REF[1]!r}D) * {side})"


def _cell_side(size: float, level: str) -> str:
    return f"({float(size)!r}D / pow(2D, {level}))"


def polygon_cover(polygons: DataFrame, size: float = 4.0, levels: int = 12, max_edges: int = 16,
                  splits: int = 3) -> DataFrame:
    """Square cells of mixed levels that cover each area: cells inside it, and cells with the edges that touch them.

    A cell of level k has the side ``size / 2**k``. An area starts at the level of its own extent and cells are split in 8 x 8, at most ``splits``
    times, while they hold more than ``max_edges`` edges or are wide beside the area; cells outside are dropped. ``inside``
    says whether the cell's reference point is in the area. It is known for a child from its parent's point: the segment
    between both stays in the parent, so only the parent's edges can lie between. Cells without ``edges`` are wholly inside.
    """
    ends = lambda fn, of, p, q: f"array_{fn}(transform(edges, e -> {of}(e.{p}, e.{q})))"
    box = "bx1", "bx2", "by1", "by2"
    side = _cell_side(size, "level")
    whole = ring_edges(polygons).groupBy("area_id").agg(F.flatten(F.collect_list("edges")).alias("edges")).selectExpr(
        "area_id", "edges", f"{ends('min', 'least', 'x1', 'x2')} AS bx1", f"{ends('max', 'greatest', 'x1', 'x2')} AS bx2",
        f"{ends('min', 'least', 'y1', 'y2')} AS by1", f"{ends('max', 'greatest', 'y1', 'y2')} AS by2").selectExpr(
        "*", "greatest(bx2 - bx1, by2 - by1) AS _extent").selectExpr(
        "*", f"CAST(greatest(0, least({levels}, coalesce(floor(log2({float(size)!r}D / _extent)), {levels}))) AS INT) AS level")
    span = lambda low, high: f"sequence(floor({low} / {side}), floor({high} / {side}))"
    roots = whole.selectExpr("*", f"explode({span('by1', 'by2')}) AS iy").selectExpr("*", f"explode({span('bx1', 'bx2')}) AS ix")
    rx, ry = _reference("ix", "iy", side)
    ray = f"(e.y1 > {ry}) != (e.y2 > {ry}) AND {rx} < (e.x2 - e.x1) * ({ry} - e.y1) / nullif(e.y2 - e.y1, 0D) + e.x1"
    # Only here all edges are asked; from these cells on the edges in the cell are enough.
    cells = roots.selectExpr("area_id", *box, "_extent", "level", "ix", "iy", f"size(filter(edges, e -> {ray})) % 2 = 1 AS inside",
                             f"{_touching('ix', 'iy', side)} AS edges").filter("inside OR size(edges) > 0")
    fine, x, y = _cell_side(size, "(level + 3)"), "(ix * 8 + q % 8)", "(iy * 8 + q div 8)"
    child = (f"struct(level + 3 AS level, {x} AS ix, {y} AS iy, "
             f"inside != ({_crossings(rx, ry, *_reference(x, y, fine))} % 2 = 1) AS inside, {_touching(x, y, fine)} AS edges)")
    split = f"level + 3 <= {levels} AND size(edges) > 0 AND (size(edges) > {max_edges} OR {side} * 2 > _extent)"
    for _ in range(splits):
        cells = cells.selectExpr("area_id", *box, "_extent", f"""inline(CASE WHEN {split}
            THEN transform(sequence(0L, 63L), q -> {child}) ELSE array(struct(level, ix, iy, inside, edges)) END)""").filter(
            "inside OR size(edges) > 0")
    return cells.select("area_id", *box, "level", "ix", "iy", "inside", "edges")


def candidate_pairs(points: DataFrame, cover: DataFrame, size: float = 4.0, levels: int = 12) -> DataFrame:
    """Points (``_px``, ``_py``) beside the cover's cells they lie in, found by the point's cell at every level."""
    side = _cell_side(size, "level")
    placed = points.selectExpr("*", f"explode(sequence(0, {levels})) AS level").selectExpr(
        "*", f"floor(_px / {side}) AS ix", f"floor(_py / {side}) AS iy")
    return placed.join(cover, ["level", "ix", "iy"])


def assign_area(points: DataFrame, polygons: DataFrame, point_id: str, lon: str = "lon", lat: str = "lat",
                size: float = 4.0, levels: int = 12) -> DataFrame:
    """Area strictly containing each point; the smallest id when several do, null when none does.

    ``points`` should hold distinct places, so a busy place is tested once. Points meet the cells of
    :func:`polygon_cover`: in a cell inside an area nothing is tested; elsewhere the area's box, then the edges of that
    cell alone, against the segment from the cell's reference point.
    """
    pts = points.select(point_id, F.col(lon).cast("double").alias("_px"), F.col(lat).cast("double").alias("_py")).dropna()
    boxed = "_px > bx1 AND _px < bx2 AND _py > by1 AND _py < by2"
    on_edge = (f"exists(edges, e -> {_turn('_px', '_py')} = 0 AND _px BETWEEN least(e.x1, e.x2) AND greatest(e.x1, e.x2) "
               "AND _py BETWEEN least(e.y1, e.y2) AND greatest(e.y1, e.y2))")
    turns = f"{_crossings(*_reference('ix', 'iy', _cell_side(size, 'level')), '_px', '_py')} % 2 = 1"
    inside = candidate_pairs(pts, polygon_cover(polygons, size, levels), size, levels).filter(
        f"CASE WHEN size(edges) = 0 THEN inside ELSE {boxed} AND inside != ({turns}) AND NOT {on_edge} END")
    found = inside.groupBy(point_id).agg(F.min("area_id").alias("area_id"))
    return points.select(point_id).join(found, point_id, "left")


def polygon_measures(polygons: DataFrame) -> DataFrame:
    """Centroid in degrees and in Mercator metres, and planar Mercator area in km², per area.

    Signed sums over the exploded edges, so a ring's size does not matter. ``is_hole`` marks
    rings to subtract.
    """
    ring = ring_edges(polygons, ["area_id", "part", "is_hole"])
    e = ring.select("area_id", "part", "is_hole", F.element_at("edges", 1).alias("o"), F.explode("edges").alias("e"))
    # Offsets from the ring's first vertex keep the cross products small.
    for tag, fx, fy in (("d", lambda c: c, lambda c: c), ("m", mercator_x, mercator_y)):
        for i in ("1", "2"):
            e = e.withColumn(f"{tag}x{i}", fx(F.col(f"e.x{i}")) - fx(F.col("o.x1"))).withColumn(
                f"{tag}y{i}", fy(F.col(f"e.y{i}")) - fy(F.col("o.y1")))
    cross = lambda t: F.col(f"{t}x1") * F.col(f"{t}y2") - F.col(f"{t}x2") * F.col(f"{t}y1")
    aggs = [F.first("o").alias("o")]
    for t in ("d", "m"):
        aggs += [F.sum(cross(t)).alias(f"{t}a"),
                 F.sum((F.col(f"{t}x1") + F.col(f"{t}x2")) * cross(t)).alias(f"{t}cx"),
                 F.sum((F.col(f"{t}y1") + F.col(f"{t}y2")) * cross(t)).alias(f"{t}cy")]
    per_ring = e.groupBy("area_id", "part", "is_hole").agg(*aggs)
    sign = F.when(F.col("is_hole"), -1.0).otherwise(1.0)
    out = per_ring
    for t, ox, oy in (("d", F.col("o.x1"), F.col("o.y1")), ("m", mercator_x("o.x1"), mercator_y("o.y1"))):
        out = out.withColumn(f"{t}w", sign * F.abs(F.col(f"{t}a")) / 2).withColumn(
            f"{t}gx", ox + F.try_divide(F.col(f"{t}cx"), 3 * F.col(f"{t}a"))).withColumn(
            f"{t}gy", oy + F.try_divide(F.col(f"{t}cy"), 3 * F.col(f"{t}a")))
    mean = lambda t, g: F.sum(F.col(f"{t}w") * F.col(f"{t}{g}")) / F.sum(f"{t}w")
    return out.groupBy("area_id").agg(
        mean("d", "gx").alias("lon"), mean("d", "gy").alias("lat"), mean("m", "gx").alias("x"),
        mean("m", "gy").alias("y"), (F.sum("mw") / 1e6).alias("area_km2"))


def interior_points(polygons: DataFrame) -> DataFrame:
    """A point inside each area: the middle of its widest stretch along the line half way up its box; ties go west.

    Even and odd crossings of all rings, holes included, bound the stretches. An area that the line does not cross (no extent) has no row.
    """
    edges = ring_edges(polygons).groupBy("area_id").agg(F.flatten(F.collect_list("edges")).alias("edges"))
    line = edges.selectExpr("area_id", "edges", """(array_min(transform(edges, e -> least(e.y1, e.y2)))
        + array_max(transform(edges, e -> greatest(e.y1, e.y2)))) / 2 AS lat""")
    cut = line.selectExpr("area_id", "lat", """array_sort(transform(filter(edges, e -> (e.y1 > lat) != (e.y2 > lat)),
        e -> (e.x2 - e.x1) * (lat - e.y1) / (e.y2 - e.y1) + e.x1)) AS xs""").filter("size(xs) > 1")
    stretch = "transform(sequence(0, size(xs) div 2 - 1), i -> struct(xs[2 * i] - xs[2 * i + 1] AS less, xs[2 * i] AS a, xs[2 * i + 1] AS b))"
    return cut.selectExpr("area_id", "lat", f"array_min({stretch}) AS w").selectExpr("area_id", "(w.a + w.b) / 2 AS lon", "lat")


def in_box(lat: str | Column, lon: str | Column, lat_min: float, lat_max: float, lon_min: float,
           lon_max: float) -> Column:
    lat = F.col(lat) if isinstance(lat, str) else lat
    lon = F.col(lon) if isinstance(lon, str) else lon
    return lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max)


# --- nearest centre ----------------------------------------------------------------

def nearest_area(points: DataFrame, centres: DataFrame, point_id: str, lon: str = "lon", lat: str = "lat",
                 finest: float = 0.01, levels: int = 18) -> DataFrame:
    """Area whose centre is nearest in plain degrees; ties go to the smaller id.

    Tiles double in size per level. If a point's tile at level k holds a centre, the nearest
    centre is at most one tile diagonal away, hence inside the 3 x 3 block at level k + 1. So
    every point searches just that block, small where centres are dense.
    """
    top = 1 << (levels - 1)
    if finest * top < 720:
        raise ValueError("the coarsest level must span the globe")
    ix = lambda c: F.floor((F.col(c) + 360.0) / finest)
    def at_levels(df: DataFrame, lo: int) -> DataFrame:
        """The tile of ``_ix``, ``_iy`` at every level from ``lo`` up."""
        every = df.withColumn("level", F.explode(F.sequence(F.lit(lo), F.lit(levels))))
        return every.selectExpr("*", "shiftright(_ix, level) AS tx", "shiftright(_iy, level) AS ty")

    c = centres.select("area_id", F.col("lon").alias("_cx"), F.col("lat").alias("_cy")).dropna().groupBy(
        "_cx", "_cy").agg(F.min("area_id").alias("area_id"))
    ctiles = c.withColumn("_ix", ix("_cx")).withColumn("_iy", ix("_cy"))
    pts = points.select(point_id, F.col(lon).alias("_px"), F.col(lat).alias("_py")).dropna().withColumn(
        "_ix", ix("_px")).withColumn("_iy", ix("_py"))
    # Smallest occupied level per finest tile of the points, not per point.
    occupied = at_levels(ctiles.select("_ix", "_iy").distinct(), 0).select("level", "tx", "ty").distinct()
    probes = pts.select("_ix", "_iy").distinct()
    found = at_levels(probes, 0).join(
        occupied, ["level", "tx", "ty"], "left_semi").groupBy("_ix", "_iy").agg(F.min("level").alias("_k"))
    search = (
        found.withColumn("_d", F.explode(F.sequence(F.lit(0), F.lit(8))))
        .selectExpr("_ix", "_iy", "_k", "_k + 1 AS level", "shiftright(_ix, _k + 1) + _d % 3 - 1 AS tx",
                    "shiftright(_iy, _k + 1) + _d div 3 - 1 AS ty")
    )
    leveled = at_levels(ctiles, 1).drop("_ix", "_iy")
    # A centre farther from the tile than the diagonal bound cannot win for any point in it.
    gap = lambda v, i: F.greatest(F.lit(0.0), F.col(i) * finest - 360.0 - F.col(v),
                                  F.col(v) - ((F.col(i) + 1) * finest - 360.0))
    reach = F.pow(F.lit(2.0), F.col("_k")) * (finest * math.sqrt(2) * 1.000001)
    candidates = search.join(leveled, ["level", "tx", "ty"]).filter(
        gap("_cx", "_ix") * gap("_cx", "_ix") + gap("_cy", "_iy") * gap("_cy", "_iy") <= reach * reach
    ).select("_ix", "_iy", "area_id", "_cx", "_cy")
    dx, dy = F.col("_px") - F.col("_cx"), F.col("_py") - F.col("_cy")
    best = pts.join(candidates, ["_ix", "_iy"]).groupBy(point_id).agg(
        F.min(F.struct((dx * dx + dy * dy).alias("d2"), F.col("area_id").alias("area_id"))).alias("_m"))
    return best.select(point_id, F.col("_m.area_id").alias("area_id"))


# --- exposure by radius of a moving centre --------------------------------------------

KM_PER_NAUTICAL_MILE = 1.852


QUADRANTS = ("ne", "se", "sw", "nw")
#: Cells on the side of a tile.
CELLS = 8
# The cells' bounds are widened by more than rounding can move them, so they never settle what the exact test would not.
_SLACK, _SLACK_KM = 1e-9, 1e-6


def exposure_class(track: DataFrame, areas: DataFrame, thresholds: Sequence[int] = (34, 50, 64),
                   size: float = 1.0) -> DataFrame:
    """Highest wind threshold whose radius reached each area's point, per event.

    ``track``: ``disaster``, ``lat``, ``lon`` and, per threshold and quadrant, a radius in
    nautical miles ``r34_ne`` ... ``r64_nw``. ``areas``: ``area_id``, ``lat``, ``lon``. Areas out of
    reach are absent. Each observation point is tested on its own; a radius that is missing or NaN reaches nothing.
    """
    return _reached(_standing(_fixes(track, thresholds), thresholds), areas, thresholds, size)


def exposure_swept(track: DataFrame, areas: DataFrame, order: str = "t", thresholds: Sequence[int] = (34, 50, 64),
                   size: float = 1.0) -> DataFrame:
    """Highest wind threshold whose footprint, swept along the track, reached each area's point, per event.

    As :func:`exposure_class`, with fixes joined to their successor by ``order``: between two fixes the centre moves
    straight and the radii change evenly (a missing one counts as 0). A point is tested at each fix and at the
    place of the segment nearest to it. Segments, not steps along them, meet the cells of the points.
    Fixes without a position are left out; a segment across the date line is not followed.
    """
    fixes = _fixes(track.withColumn("_t", F.col(order)), thresholds, "_t")
    moving = _successors(fixes, thresholds).filter("lat != lat_2 OR lon != lon_2")
    return _reached(_standing(fixes, thresholds), areas, thresholds, size, _outer(moving, thresholds))


def _once(df: DataFrame, *exprs: str) -> DataFrame:
    """``df`` with columns that are computed once; plain ones are copied to wherever they are used, filters included."""
    return df.selectExpr("*", f"inline(array(struct({', '.join(exprs)})))")


def _radii(thresholds: Sequence[int]) -> list[str]:
    return [f"r{t}_{q}" for t in thresholds for q in QUADRANTS]


def _placed(df: DataFrame) -> DataFrame:
    return df.filter("lat IS NOT NULL AND lon IS NOT NULL AND NOT isnan(lat) AND NOT isnan(lon)")


def _fixes(track: DataFrame, thresholds: Sequence[int], *more: str) -> DataFrame:
    return _placed(track.withColumns({c: F.col(c).cast("double") for c in ("lat", "lon")})).select(
        "disaster", *more, "lat", "lon",
        *[F.coalesce(F.nanvl(F.col(r).cast("double"), F.lit(0.0)), F.lit(0.0)).alias(r) for r in _radii(thresholds)])


def _standing(fixes: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Fixes as segments without length; of those at one place only the largest radii count."""
    radii = _radii(thresholds)
    merged = fixes.groupBy("disaster", "lat", "lon").agg(*[F.max(r).alias(r) for r in radii])
    return _once(merged, *[f"{c} AS {c}_2" for c in ("lat", "lon", *radii)])


def _successors(fixes: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Each fix with the next one of its event by ``_t``.

    A track may be as long as the input, so no task orders a whole one: stretches of it are ordered apart, and the last fix of each
    takes the first of the next. The stretches are written once, as they must be the same for both.
    """
    spark, columns = fixes.sparkSession, ("lat", "lon", *_radii(thresholds))
    stretches = staged(fixes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "disaster", "_t").withColumn(
        "_stretch", F.spark_partition_id()), "track")
    first = stretches.groupBy("disaster", "_stretch").agg(F.min(F.struct("_t", *columns)).alias("_f"))
    follow = first.select("disaster", "_stretch", F.lead("_f").over(Window.partitionBy("disaster").orderBy("_stretch")).alias("_f"))
    along = Window.partitionBy("disaster", "_stretch").orderBy("_t", *columns)
    legs = stretches.withColumn("_n", F.lead(F.struct(*columns)).over(along)).join(follow, ["disaster", "_stretch"])
    return _once(legs, *[f"coalesce(_n.{c}, _f.{c}, {c}) AS {c}_2" for c in columns]).drop("_stretch", "_t", "_n", "_f")


def _outer(legs: DataFrame, thresholds: Sequence[int]) -> DataFrame:
    """Without segments that others over the same way outreach.

    The nearest place depends on the way alone. A radius that is nowhere above the lesser end of another's does not matter there, so a
    segment stays if one of its radii is greater at either end than all lesser ends, or has the greatest of these itself.
    """
    radii, way = _radii(thresholds), ["disaster", "lat", "lon", "lat_2", "lon_2"]
    legs = legs.groupBy(*way, *radii[:1], f"{radii[0]}_2", *radii[1:], *[f"{r}_2" for r in radii[1:]]).agg(F.lit(1).alias("_one")).drop("_one")
    sure = legs.groupBy(*way).agg(*[F.max(F.least(r, f"{r}_2")).alias(f"_m_{r}") for r in radii])
    matters = " OR ".join(f"(greatest({r}, {r}_2) > 0 AND (greatest({r}, {r}_2) > _m_{r} OR least({r}, {r}_2) = _m_{r}))" for r in radii)
    return _once(legs.join(sure, way), f"({matters}) AS _matters").filter("_matters").select(legs.columns)


def _bounded(legs: DataFrame, thresholds: Sequence[int], side: float, held: DataFrame, settled: DataFrame | None = None) -> DataFrame:
    """Segments by the cells they may reach, with the highest threshold they may reach there (``_most``) and surely reach everywhere (``_least``).

    ``held``: the cells that matter; ``settled``: by event and cell the threshold known to be reached.
    """
    radii, steps = _radii(thresholds), sorted(thresholds)
    widest = f"greatest({', '.join([*radii, *[f'{r}_2' for r in radii]])}) AS _widest"
    km = F.col("_widest") * KM_PER_NAUTICAL_MILE
    dlat = km / 110.0
    # Degrees of longitude shrink with latitude; the poles are out of range for storm tracks.
    top = F.greatest(F.abs("lat"), F.abs("lat_2")) + dlat
    dlon = km / (F.lit(110.0) * F.greatest(F.cos(F.radians(F.least(top, F.lit(89.0)))), F.lit(0.01)))
    across = lambda c, d: F.explode(F.sequence(tile(F.least(c, f"{c}_2") - d, side), tile(F.greatest(c, f"{c}_2") + d, side)))
    # _dx and _dy: the segment in degrees of latitude.
    legs = _once(legs, widest, "cos(radians((lat + lat_2) / 2)) AS _c").filter("_widest > 0")
    legs = _once(legs, "(lon_2 - lon) * _c AS _dx", "lat_2 - lat AS _dy").withColumn("_len2", F.expr("_dx * _dx + _dy * _dy"))
    legs = spread(legs, "disaster", "lat", "lon", "lat_2", "lon_2", radii[0])
    cells = legs.withColumn("tx", across("lon", dlon)).withColumn("ty", across("lat", dlat)).join(held, ["tx", "ty"])
    known = F.lit(0)
    if settled is not None:
        cells = cells.join(settled, ["disaster", "tx", "ty"], "left")
        known = F.coalesce("_settled", F.lit(0))
        cells = cells.filter(known < steps[-1])
    cells = cells.selectExpr("*", *[f"{c} * {side!r}D - {_SLACK!r}D AS _{v}0" for c, v in (("tx", "x"), ("ty", "y"))],
                             *[f"({c} + 1) * {side!r}D + {_SLACK!r}D AS _{v}1" for c, v in (("tx", "x"), ("ty", "y"))])
    along = lambda pick: (f"{pick}((_x0 - lon) * _c * _dx, (_x1 - lon) * _c * _dx) + {pick}((_y0 - lat) * _dy, (_y1 - lat) * _dy)")
    slack = f"({_SLACK!r}D + 1e-11D / sqrt(_len2))"
    within = lambda pick, sign: (f"CASE WHEN _len2 > 0 THEN least(1D, greatest(0D, ({along(pick)}) / _len2 {sign} {slack})) ELSE 0D END")
    cells = _once(cells, f"{within('least', '-')} AS _s0", f"{within('greatest', '+')} AS _s1")
    ends = lambda c: [f"{c} + {e} * ({c}_2 - {c})" for e in ("_s0", "_s1")]
    cells = _once(cells, *[f"{pick}({', '.join(ends(c))}) {sign} {_SLACK!r}D AS _{c}{k}" for c in ("lat", "lon")
                                    for k, (pick, sign) in enumerate((("least", "-"), ("greatest", "+")))])
    # Least and greatest distance between the centre's box and the cell; differences beyond half a turn are taken as any.
    cells = _once(
        cells, "greatest(0D, _y0 - _lat1, _lat0 - _y1) AS _u0", "least(180D, greatest(_y1 - _lat0, _lat1 - _y0)) AS _u1",
        "CASE WHEN greatest(_x1 - _lon0, _lon1 - _x0) > 180 THEN 0D ELSE greatest(0D, _x0 - _lon1, _lon0 - _x1) END AS _v0",
        "least(180D, greatest(_x1 - _lon0, _lon1 - _x0)) AS _v1", *[
            f"cos(radians({fn})) AS _c{n}" for n, fn in (
                ("l0", "greatest(abs(_lat0), abs(_lat1))"), ("l1", "CASE WHEN _lat0 < 0 AND _lat1 > 0 THEN 0D ELSE least(abs(_lat0), abs(_lat1)) END"),
                ("y0", "greatest(abs(_y0), abs(_y1))"), ("y1", "CASE WHEN _y0 < 0 AND _y1 > 0 THEN 0D ELSE least(abs(_y0), abs(_y1)) END"))])
    span = lambda k: (f"asin(sqrt(least(1D, greatest(0D, pow(sin(radians(_u{k}) / 2), 2) + greatest(0D, _cl{k}) * greatest(0D, _cy{k}) "  # noqa: E731
                      f"* pow(sin(radians(_v{k}) / 2), 2))))) * {2 * EARTH_RADIUS_KM!r}D")
    cells = _once(
        cells, f"{span(0)} * {1 - _SLACK!r}D - {_SLACK_KM!r}D AS _near", f"{span(1)} * {1 + _SLACK!r}D + {_SLACK_KM!r}D AS _far",
        "_y1 >= _lat0 AS _north", "_y0 < _lat1 AS _south", "_x1 >= _lon0 AS _east", "_x0 < _lon1 AS _west")
    sides = {"ne": "_north AND _east", "se": "_south AND _east", "sw": "_south AND _west", "nw": "_north AND _west"}
    most, least = "0", "0"
    for t in steps:
        high = f"greatest({', '.join(f'CASE WHEN {sides[q]} THEN greatest({ends(f"r{t}_{q}")[0]}, {ends(f"r{t}_{q}")[1]}) ELSE 0D END' for q in QUADRANTS)})"
        low = f"least({', '.join(f'CASE WHEN {sides[q]} THEN least({ends(f"r{t}_{q}")[0]}, {ends(f"r{t}_{q}")[1]}) END' for q in QUADRANTS)})"
        most = f"CASE WHEN {high} > 0 AND _near <= {high} * {KM_PER_NAUTICAL_MILE!r}D * {1 + _SLACK!r}D THEN {t} ELSE {most} END"
        least = f"CASE WHEN {low} > 0 AND _far <= {low} * {KM_PER_NAUTICAL_MILE!r}D THEN {t} ELSE {least} END"
    cells = _once(cells, f"{most} AS _most", f"{least} AS _least").filter(F.col("_most") > known)
    return cells.select(*legs.columns, "tx", "ty", "_most", "_least")


def _reached(standing: DataFrame, areas: DataFrame, thresholds: Sequence[int], size: float, moving: DataFrame | None = None) -> DataFrame:
    """Highest threshold of all segments at each area's point, tested at the place of the segment nearest to it.

    Segments meet cells first. What reaches all of a cell settles its points up to that threshold, and only segments that may reach more there
    are tested on the points: where tracks are dense, little is left to test. What the fixes settle is written once, as segments with length
    are only followed into the other cells.
    """
    side = float(size) / CELLS
    radii, steps = _radii(thresholds), sorted(thresholds)
    spots = _placed(areas.select("area_id", F.col("lat").cast("double"), F.col("lon").cast("double"))).select(
        "area_id", F.col("lat").alias("_alat"), F.col("lon").alias("_alon"), tile("lon", side).alias("tx"), tile("lat", side).alias("ty"))
    held, key = spots.select("tx", "ty").distinct(), ["disaster", "tx", "ty"]
    cells = _bounded(standing, thresholds, side, held)
    settled = cells.groupBy(key).agg(F.max("_least").alias("_settled"))
    if moving is not None:
        settled = staged(settled, "settled")
        more = _bounded(moving, thresholds, side, held, settled)
        cells = cells.unionByName(more)
        settled = settled.unionByName(more.select(*key, F.col("_least").alias("_settled"))).groupBy(key).agg(F.max("_settled").alias("_settled"))
    rest = cells.join(settled, key).filter("_most > _settled")
    at = _once(rest.join(spots, ["tx", "ty"]), "CASE WHEN _len2 > 0 THEN least(1D, greatest(0D, ((_alon - lon) * _c * _dx + (_alat - lat) * _dy) / _len2)) ELSE 0D END AS _s")
    at = at.withColumns({f"{c}_s": F.col(c) + F.col("_s") * (F.col(f"{c}_2") - F.col(c)) for c in ("lat", "lon", *radii)})
    north, east = F.col("_alat") >= F.col("lat_s"), F.col("_alon") >= F.col("lon_s")
    at = at.withColumns({"_km": haversine_km("lat_s", "lon_s", "_alat", "_alon"),
                         "_q": F.when(north & east, F.lit(0)).when(~north & east, F.lit(1)).when(~north & ~east, F.lit(2)).otherwise(F.lit(3))})
    wind = F.lit(0)
    for t in steps:
        radius = F.element_at(F.array(*[F.col(f"r{t}_{q}_s") for q in QUADRANTS]), F.col("_q") + 1)
        wind = F.when((radius > 0) & (F.col("_km") <= radius * KM_PER_NAUTICAL_MILE), F.lit(t)).otherwise(wind)
    tested = at.select("disaster", "area_id", wind.alias("wind_kt")).filter("wind_kt > 0")
    known = settled.filter("_settled > 0").join(spots, ["tx", "ty"]).select("disaster", "area_id", F.col("_settled").alias("wind_kt"))
    return tested.unionByName(known).groupBy("disaster", "area_id").agg(F.max("wind_kt").alias("wind_kt"))
