"""Point in polygon, nearest centre, polygon measures, exposure."""

import math
import random

import pytest

from areaflow.operators import geo

RING = "area_id string, part int, is_hole boolean, ring array<struct<x:double,y:double>>"


def test_square_with_hole_and_boundary(spark):
    square = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)]
    polys = spark.createDataFrame([
        ("B", 0, False, square), ("B", 1, True, [(1.0, 1.0), (2.0, 1.0), (2.0, 2.0), (1.0, 2.0), (1.0, 1.0)]),
        ("C", 0, False, [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0)]), ("D", 0, False, [(3.0, 3.0), (6.0, 3.0), (6.0, 6.0)])], RING)
    pts = spark.createDataFrame([
        ("in", 3.0, 0.7), ("hole", 1.5, 1.5), ("edge", 0.0, 2.0), ("corner", 4.0, 4.0), ("out", 4.5, 0.5), ("both", 5.0, 3.5),
        ("low", 2.0, 0.0), ("none", None, 1.0), ("far", -170.0, 80.0)], "id string, lon double, lat double")
    want = {"in": "B", "hole": None, "edge": None, "corner": None, "out": None, "both": "C", "low": None, "none": None, "far": None}
    for size in (0.3, 1.0, 50.0):
        got = {r.id: r.area_id for r in geo.assign_area(pts, polys, "id", size=size).collect()}
        assert got == want, size


def star(rng, x, y, r, corners):
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
    return [(x + r * rng.uniform(0.3, 1) * math.cos(t), y + r * rng.uniform(0.3, 1) * math.sin(t)) for t in turns]


def by_ray(ring, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1:
            odd = not odd
    return odd


@pytest.mark.parametrize("size", [4.0, 0.7])
def test_cover_against_every_polygon(spark, size):
    rng = random.Random(6)
    shapes = [star(rng, rng.uniform(-3, 3), rng.uniform(-3, 3), rng.choice([0.02, 0.3, 5.0]), rng.choice([3, 12, 150])) for _ in range(60)]
    shapes += [[(x / 8, y / 8), (x / 8 + 0.25, y / 8), (x / 8 + 0.25, y / 8 + 0.25), (x / 8, y / 8 + 0.25)] for x in range(-3, 3) for y in range(-3, 3)]
    polys = spark.createDataFrame([(f"{k:03}", 0, False, s) for k, s in enumerate(shapes)], RING)
    # Round numbers lie on cell borders, on lines of vertices and on edges.
    spots = [(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(500)] + [(x / 16, y / 16) for x in range(-8, 8, 1) for y in range(-7, 8, 2)]
    spots += [(s[0][0], s[0][1]) for s in shapes] + [((s[0][0] + s[1][0]) / 2 + 1e-4, (s[0][1] + s[1][1]) / 2) for s in shapes]
    edge = lambda x, y: any(
        (x2 - x1) * (y - y1) == (y2 - y1) * (x - x1) and min(x1, x2) <= x <= max(x1, x2) and min(y1, y2) <= y <= max(y1, y2)
        for s in shapes[60:] for (x1, y1), (x2, y2) in zip(s, s[1:] + s[:1]))
    pts = spark.createDataFrame([(i, *p) for i, p in enumerate(spots)], "id long, lon double, lat double")
    got = {r.id: r.area_id for r in geo.assign_area(pts, polys, "id", size=size).collect()}
    assert len(got) == len(spots)
    for i, (x, y) in enumerate(spots):
        if i < 500 or not edge(x, y) and (x, y) not in [s[0] for s in shapes]:
            assert got[i] == min((f"{k:03}" for k, s in enumerate(shapes) if by_ray(s, x, y)), default=None), (x, y)
    assert {got[i] for i, p in enumerate(spots) if p == (0.0, 0.0)} <= {f"{k:03}" for k in range(60)} | {None}


def test_a_dense_tile_has_few_candidates(spark):
    """500 areas and 100,000 places in one cell of the coarsest level: few pairs are tested."""
    rng = random.Random(12)
    shapes = [star(rng, 0.1 + 0.16 * (k % 25), 0.1 + 0.19 * (k // 25), 0.08, 40) for k in range(500)]
    polys = spark.createDataFrame([(f"{k:03}", 0, False, s) for k, s in enumerate(shapes)], RING)
    pts = spark.range(100_000).selectExpr("id", "4 * pmod(id * 0.6180339887498949D, 1) AS _px", "4 * pmod(id * 0.7548776662466927D, 1) AS _py")
    pairs = geo.candidate_pairs(pts, geo.polygon_cover(polys))
    n, edges, tested = pairs.selectExpr("count(*)", "sum(size(edges))", "count(if(size(edges) > 0, 1, null))").first()
    assert tested < 80_000 and n < 100_000 and edges / tested <= 17


def test_polygon_measures(spark):
    polys = spark.createDataFrame([
        ("A", 0, False, [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]),
        ("H", 0, False, [(0.0, 0.0), (0.0, 4.0), (4.0, 4.0), (4.0, 0.0)]),
        ("H", 1, True, [(0.0, 0.0), (2.0, 0.0), (2.0, 4.0), (0.0, 4.0)])], RING)
    got = {r.area_id: r for r in geo.polygon_measures(polys).collect()}
    assert (got["A"].lon, got["A"].lat) == (pytest.approx(1.0), pytest.approx(1.0))
    assert (got["H"].lon, got["H"].lat) == (pytest.approx(3.0), pytest.approx(2.0))
    side = math.radians(2) * 6378137
    height = 6378137 * math.log(math.tan(math.pi / 4 + math.radians(1)))
    assert got["A"].area_km2 == pytest.approx(side * height / 1e6, rel=1e-9)
    assert got["A"].x == pytest.approx(side / 2) and got["A"].y == pytest.approx(height / 2)


def test_nearest_against_brute_force(spark):
    rng = random.Random(8)
    # a dense cluster, a few scattered centres on both sides of the date line, and exact ties
    centres = [(f"c{i:03d}", rng.gauss(10, 0.01), rng.gauss(50, 0.01)) for i in range(150)]
    centres += [(f"s{i:03d}", rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(20)]
    centres += [("t2", 100.0, 0.0), ("t1", 102.0, 0.0), ("d2", -60.0, -60.0), ("d1", -60.0, -60.0)]
    pts = [(i, rng.gauss(10, 0.3), rng.gauss(50, 0.3)) for i in range(150)]
    pts += [(1000 + i, rng.uniform(-180, 180), rng.uniform(-90, 90)) for i in range(150)] + [(5000, 101.0, 0.0), (5001, -60.0, -60.0)]
    c = spark.createDataFrame(centres, "area_id string, lon double, lat double")
    p = spark.createDataFrame(pts, "id long, lon double, lat double")
    got = {r.id: r.area_id for r in geo.nearest_area(p, c, "id").collect()}
    for i, x, y in pts:
        assert got[i] == min((((x - cx) ** 2 + (y - cy) ** 2), a) for a, cx, cy in centres)[1], i
    assert len(got) == len(pts)


def test_exposure_uses_the_quadrant(spark):
    cols = "disaster string, lat double, lon double, " + ", ".join(
        f"r{t}_{q} double" for t in (34, 50, 64) for q in ("ne", "se", "sw", "nw"))
    track = spark.createDataFrame([("S", 25.0, -90.0, 100.0, 0.0, 0.0, 100.0, 60.0, 0.0, 0.0, 0.0, 30.0, 0.0, 0.0, None)], cols)
    areas = spark.createDataFrame([("near", 25.3, -89.8), ("mid", 25.7, -89.8), ("far", 26.2, -89.8), ("west", 25.3, -90.2),
                                   ("south", 24.9, -90.0), ("away", 28.0, -90.0)], "area_id string, lat double, lon double")
    got = {r.area_id: r.wind_kt for r in geo.exposure_class(track, areas).collect()}
    assert got == {"near": 64, "mid": 50, "far": 34, "west": 34}


def test_a_footprint_is_swept_between_fixes(spark):
    cols = "disaster string, t int, lat double, lon double, " + ", ".join(
        f"r{t}_{q} double" for t in (34, 50, 64) for q in ("ne", "se", "sw", "nw"))
    fix = lambda t, lat, lon, r34, r50=0.0, r64=None: ("S", t, lat, lon, *[r34] * 4, *[r50] * 4, *[r64] * 4)
    track = spark.createDataFrame([fix(2, 25.0, -86.0, 60.0), fix(1, 25.0, -90.0, 60.0, 40.0), fix(3, None, -80.0, 500.0),
                                   ("T", 1, 10.0, -60.0, *[30.0] * 4, *[0.0] * 8)], cols)
    areas = spark.createDataFrame([("between", 25.5, -88.0), ("early", 25.5, -89.5), ("beside", 26.5, -88.0), ("ahead", 25.0, -84.5),
                                   ("fix", 25.0, -90.5), ("alone", 10.2, -60.0), ("nowhere", None, -88.0)],
                                  "area_id string, lat double, lon double")
    swept = {r.area_id: r.wind_kt for r in geo.exposure_swept(track, areas).collect()}
    # 0.5 degrees are 55.6 km, or 30 nautical miles: the radius of 40 at the first fix has shrunk to 20 half way.
    assert swept == {"between": 34, "early": 50, "fix": 50, "alone": 34}
    points = {r.area_id for r in geo.exposure_class(track, areas).collect()}
    assert "between" not in points and points <= set(swept)


QUARTERS = ("ne", "se", "sw", "nw")
TRACK = "disaster string, t int, lat double, lon double, " + ", ".join(f"r{t}_{q} double" for t in (34, 50, 64) for q in QUARTERS)


def _class_at(lat, lon, radii, alat, alon):
    h = math.sin(math.radians(alat - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(alat)) * math.sin(math.radians(alon - lon) / 2) ** 2
    km, q = 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h))), (0 if alon >= lon else 3) if alat >= lat else (1 if alon >= lon else 2)
    return max([t for k, t in enumerate((34, 50, 64)) if radii[4 * k + q] > 0 and km <= radii[4 * k + q] * 1.852], default=0)


def test_exposure_on_a_long_track_against_brute_force(spark):
    rng = random.Random(5)
    ways = [(20 + i % 4 * 0.4, -90 + i // 4 * 0.7) for i in range(16)] + [(-0.2, 0.1), (0.3, -0.2)]
    track = []
    for i in range(400):
        wide = rng.expovariate(1 / 12)
        track.append((rng.choice("AB"), i, *ways[i * 7 % len(ways)], *[max(0.0, wide * f / t * 34 - 3) for t in (34, 50, 64) for f in (2, 1.5, 1, 1.2)]))
    areas = [(f"a{i}", rng.uniform(18, 24), rng.uniform(-92, -85)) for i in range(250)] + [("z1", 0.05, 0.05), ("z2", -0.4, -0.4), ("z3", 0.0, 0.0)]
    df, spots = spark.createDataFrame(track, TRACK), spark.createDataFrame(areas, "area_id string, lat double, lon double")
    still, swept = {}, {}
    for d in "AB":
        own = [r for r in track if r[0] == d]
        for a, alat, alon in areas:
            still[d, a] = max(_class_at(r[2], r[3], r[4:], alat, alon) for r in own)
            swept[d, a] = still[d, a]
            for r, n in zip(own, own[1:]):
                c = math.cos(math.radians((r[2] + n[2]) / 2))
                dx, dy = (n[3] - r[3]) * c, n[2] - r[2]
                if dx or dy:
                    s = min(1.0, max(0.0, ((alon - r[3]) * c * dx + (alat - r[2]) * dy) / (dx * dx + dy * dy)))
                    lat, lon, *radii = [x + s * (y - x) for x, y in zip(r[2:], n[2:])]
                    swept[d, a] = max(swept[d, a], _class_at(lat, lon, radii, alat, alon))
    assert {(r.disaster, r.area_id): r.wind_kt for r in geo.exposure_class(df, spots).collect()} == {k: v for k, v in still.items() if v}
    assert {(r.disaster, r.area_id): r.wind_kt for r in geo.exposure_swept(df, spots).collect()} == {k: v for k, v in swept.items() if v}
    assert {v for v in swept.values()} == {0, 34, 50, 64}


def test_fixes_at_one_place_and_segments_over_one_way_are_merged(spark):
    fix = lambda t, lat, r, r2: ("S", t, lat, -90.0, *[float(r)] * 4, *[float(r2)] * 4, *[0.0] * 4)
    # Twice a day between two places: radii of 10 to 39, the greatest last.
    track = spark.createDataFrame([fix(t, 25.0 + t % 2, 10 + t // 2, t // 2) for t in range(60)], TRACK)
    fixes = geo._fixes(track.withColumn("_t", track.t), (34, 50, 64), "_t")
    assert geo._standing(fixes, (34, 50, 64)).count() == 2
    legs = geo._successors(fixes, (34, 50, 64))
    assert sorted((r.lat, r.lat_2, r.r34_ne, r.r34_ne_2) for r in legs.collect()) == sorted(
        (25.0 + t % 2, 25.0 + (t + 1) % 2 if t < 59 else 26.0, 10.0 + t // 2, 10.0 + min(59, t + 1) // 2) for t in range(60))
    kept = geo._outer(legs.filter("lat != lat_2"), (34, 50, 64)).collect()
    # Up: the last alone. Down: its lesser end is that of the last but one fix.
    assert sorted((r.lat, r.r34_ne, r.r34_ne_2) for r in kept) == [(25.0, 39.0, 39.0), (26.0, 38.0, 39.0)]


def test_a_radius_that_is_no_number_reaches_nothing(spark):
    nan = float("nan")
    track = spark.createDataFrame([("S", 1, 0.5, 0.5, *[nan] * 12), ("S", 2, nan, 0.5, *[90.0] * 12), ("T", 1, 0.5, 0.5, 20.0, *[nan] * 11)], TRACK)
    areas = spark.createDataFrame([("in", 0.6, 0.6), ("no", nan, 0.6)], "area_id string, lat double, lon double")
    for found in (geo.exposure_class(track, areas), geo.exposure_swept(track, areas)):
        assert [tuple(r) for r in found.collect()] == [("T", "in", 34)]


def test_interior_points_lie_inside(spark):
    arc = [(math.cos(t / 20 * math.pi), math.sin(t / 20 * math.pi)) for t in range(-14, 15)]
    crescent = [(2 * x, 2 * y) for x, y in arc] + [(1.7 * x - 0.2, 1.7 * y) for x, y in reversed(arc)]
    polys = spark.createDataFrame([
        ("crescent", 0, False, crescent), ("ring", 0, False, [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0)]),
        ("ring", 1, True, [(1.0, 1.0), (6.0, 1.0), (6.0, 8.0), (1.0, 8.0)]), ("flat", 0, False, [(0.0, 5.0), (1.0, 5.0), (2.0, 5.0)])], RING)
    found = geo.interior_points(polys)
    at = {r.area_id: (r.lon, r.lat) for r in found.collect()}
    assert set(at) == {"crescent", "ring"} and at["ring"] == (7.5, 4.5)
    for name in at:
        inside = geo.assign_area(found.filter(f"area_id = '{name}'").withColumnRenamed("area_id", "id"), polys.filter(f"area_id = '{name}'"), "id")
        assert inside.first().area_id == name
