"""The exact null model against all pairs."""

import math
import random
from collections import Counter

import pytest

from areaflow.operators import ties


def km(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(
        math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, h)))


@pytest.mark.parametrize("bits", [(3, 6, 9, 12), (5,)])
def test_counts_of_all_pairs(spark, bits):
    rng = random.Random(2)
    at = [(rng.gauss(40, 0.3), rng.gauss(-100, 0.3)) for _ in range(90)] + [(rng.uniform(-80, 80), rng.uniform(-180, 179)) for _ in range(40)]
    at += [at[0], (10.0, 179.99), (10.0, -179.99), (-60.0, 0.0)]
    cells = spark.createDataFrame([(i, *p) for i, p in enumerate(at)] + [(900, None, None)], "cell_id long, lat double, lon double")
    homes = [rng.randrange(len(at)) for _ in range(400)] + [7] * 300 + [900, 901]
    users = spark.createDataFrame(list(enumerate(homes)), "user_id long, home_cell long")
    n, edges = Counter(h for h in homes if h < 900), ties.DISTANCE_EDGES_KM
    want = Counter()
    for i in n:
        for j in n:
            d = km(at[i], at[j])
            if i != j and edges[0] <= d <= edges[-1]:
                want[next(b for b in range(54) if d < edges[b + 1] or b == 53)] += n[i] * n[j]
    got = {r.bin: r.null_n for r in ties.exact_null_counts(users, cells, bits=bits).collect() if r.null_n}
    assert got == dict(want)


def test_far_places_are_settled_in_whole_nodes(spark, monkeypatch):
    """Two dense towns: the pairs between them are counted by few pairs of nodes."""
    kept = []
    monkeypatch.setattr(ties, "staged", lambda df, label: kept.append(df.cache()) or kept[-1])
    rows = [(k * 1000 + i, 40.0 + i % 30 / 1e4, lon + i // 30 / 1e4) for k, lon in enumerate((-100.0, -97.13)) for i in range(600)]
    cells = spark.createDataFrame(rows, "cell_id long, lat double, lon double")
    users = spark.createDataFrame([(r[0], r[0]) for r in rows], "user_id long, home_cell long")
    got = {r.bin: r.null_n for r in ties.exact_null_counts(users, cells).collect()}
    assert got[max(got)] == 2 * 600 * 600
    between = kept[-1].filter("done AND w > 0").count() if len(kept) == 6 else 0
    assert sum(df.count() for df in kept[1:]) - between < 5000


def test_no_users(spark):
    cells = spark.createDataFrame([(1, 1.0, 1.0)], "cell_id long, lat double, lon double")
    assert ties.exact_null_counts(spark.createDataFrame([], "user_id long, home_cell long"), cells).count() == 0
