"""Small graphs with known metrics; a random graph against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from areaflow.operators import network as N


def graph(spark, edges, areas):
    """edges: u, v, weight; areas: user -> area"""
    users = spark.createDataFrame(list(areas.items()), "user_id long, area_id string")
    pairs = spark.createDataFrame([(u, v, w, 0) for u, v, w in edges], "u long, v long, n_voice long, n_sms long")
    return N.between_users(pairs, users), users


def test_pairs_are_canonical_and_limited_to_users(spark):
    ev = "a_id long, b_id long"
    voice = spark.createDataFrame([(2, 1), (1, 2), (3, 3), (1, 9)], ev)
    sms = spark.createDataFrame([(1, 2), (2, 3)], ev)
    users = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "user_id long, area_id string")
    got = {(r.u, r.v, r.n_voice, r.n_sms, r.n_total) for r in N.interaction_edges(voice, sms, users).collect()}
    assert got == {(1, 2, 2, 1, 3), (2, 3, 0, 1, 1)}


def test_triangle_and_star(spark):
    edges, users = graph(spark, [(1, 2, 5), (1, 3, 5), (2, 3, 1), (3, 4, 5), (10, 11, 5), (10, 12, 5)],
                         {**{i: "A" for i in range(1, 6)}, 10: "B", 11: "B", 12: "B"})
    c = {(r.threshold_m, r.node): r.clustering for r in N.local_clustering(edges, [1, 2]).collect()}
    assert c[(1, 1)] == 1.0 and c[(1, 3)] == pytest.approx(1 / 3) and c[(1, 4)] == 0.0 and c[(1, 10)] == 0.0
    assert c[(2, 1)] == 0.0
    # user 5 has no edges and still counts in its area's mean
    a = {(r.threshold_m, r.area_id): r.clustering for r in N.area_clustering(
        N.local_clustering(edges, [1, 2]), users, [1, 2]).collect()}
    assert a[(1, "A")] == pytest.approx((1 + 1 + 1 / 3) / 5) and a[(2, "A")] == 0.0
    s = {(r.threshold_m, r.area_id): r.support_ratio for r in N.support_ratio(edges, 3, [1, 2]).collect()}
    assert s == {(1, "A"): 0.75, (2, "A"): 0.0}
    assert {r.area_id for r in N.support_ratio(edges, 0, [1, 2]).collect()} == {"A", "B"}


def test_random_graph_against_brute_force(spark):
    rng = random.Random(3)
    nodes = range(40)
    # node 0 is tied to everyone: a hub with a large part of all edges
    edges = [(u, v, rng.randint(1, 4)) for u, v in itertools.combinations(nodes, 2) if u == 0 or rng.random() < 0.15]
    frame, _ = graph(spark, edges, {i: "AB"[i % 2] for i in nodes})
    for m in (1, 3):
        adj = {i: set() for i in nodes}
        for u, v, w in edges:
            if w >= m:
                adj[u].add(v)
                adj[v].add(u)
        got = {r.node: (r.degree, r.triangles) for r in N.local_clustering(frame, [m]).collect()}
        for i in nodes:
            tri = sum(1 for a, b in itertools.combinations(sorted(adj[i]), 2) if b in adj[a])
            assert got.get(i, (0, 0)) == (len(adj[i]), tri)
        kept = [(u, v) for u, v, w in edges if w >= m and u % 2 == v % 2]
        near = {i: {x for x in adj[i] if x % 2 == i % 2} for i in nodes}
        want = {}
        for k in (0, 1):
            mine = [(u, v) for u, v in kept if u % 2 == k]
            want["AB"[k]] = sum(bool(near[u] & near[v]) for u, v in mine) / len(mine)
        ratio = {r.area_id: r.support_ratio for r in N.support_ratio(frame, 0, [m]).collect()}
        assert ratio == pytest.approx(want)


def test_triangles_once_with_their_least_weight(spark):
    rng = random.Random(8)
    weight = {(u, v): rng.randint(1, 6) for u, v in itertools.combinations(range(25), 2) if u < 2 or rng.random() < 0.3}
    areas = {i: "ABC"[i % 3] for i in range(25)}
    frame, _ = graph(spark, [(u, v, w) for (u, v), w in weight.items()], areas)
    want = {t: min(weight[p] for p in itertools.combinations(t, 2)) for t in itertools.combinations(range(25), 3)
            if all(p in weight for p in itertools.combinations(t, 2))}
    rows = [(tuple(sorted((r.a, r.b, c.node))), c.w, (r.area_a, r.area_b, c.area) == tuple(areas[n] for n in (r.a, r.b, c.node)))
            for r in N.weighted_triangles(frame).collect() for c in r.common]
    assert len(rows) == len(want) and {t: w for t, w, _ in rows} == want and all(ok for *_, ok in rows)
    # Sweeps over one enumeration equal separate networks.
    shared = N.weighted_triangles(frame)
    swept = {(r.threshold_m, r.node, r.degree, r.triangles) for r in N.local_clustering(frame, [1, 3, 5, 9], shared).collect()}
    alone = {(r.threshold_m, r.node, r.degree, r.triangles) for m in (1, 3, 5, 9) for r in N.local_clustering(frame, [m]).collect()}
    assert swept == alone and not any(m == 9 for m, *_ in swept)
    ratio = lambda df: {(r.threshold_m, r.area_id): (r.n_edges, r.support_ratio) for r in df.collect()}
    one = {}
    for m in (1, 3, 5):
        one |= ratio(N.support_ratio(frame, 0, [m]))
    assert ratio(N.support_ratio(frame, 0, [1, 3, 5], shared)) == one


def test_connectedness_counts_missing_income_as_low(spark):
    edges, users = graph(spark, [(1, 2, 1), (1, 3, 1), (4, 2, 1)], {1: "L", 2: "H", 3: "L", 4: "N", 5: "H", 6: "H"})
    income = spark.createDataFrame([("L", 10.0), ("H", 30.0), ("M", 20.0)], "area_id string, median_income double")
    # user-weighted median over L, L, H, H, H is 30, so nobody is strictly above it
    assert not any(r.high for r in N.area_income_class(users, income).collect())
    classes = spark.createDataFrame([("L", False), ("H", True), ("N", False)], "area_id string, high boolean")
    got = {r.area_id: r.ec for r in N.economic_connectedness(edges, classes, [1]).collect()}
    assert got == {"L": pytest.approx(2 * (0.5 + 0.0) / 2), "N": 2.0}


def test_degree_sizes(spark):
    edges, _ = graph(spark, [(1, 2, 5), (1, 3, 1)], {1: "A", 2: "A", 3: "A"})
    got = {r.threshold_m: (r.n_edges, r.n_nodes) for r in N.network_size(N.degrees(edges, [1, 2, 9]), [1, 2, 9]).collect()}
    assert got == {1: (2, 3), 2: (1, 2), 9: (0, 0)}
    p = {(r.threshold_m, r.degree): r.p for r in N.degree_pmf(N.degrees(edges, [1])).collect()}
    assert p == {(1, 1): pytest.approx(2 / 3), (1, 2): pytest.approx(1 / 3)}


def test_correlation_needs_three_pairs(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 4.0), ("b", 1.0, 1.0), ("b", 2.0, 0.0), ("b", 3.0, -1.0), ("b", 9.0, None)],
                               "g string, x double, y double")
    got = {r.g: (r.rho, r.n) for r in N.correlation(df, "x", "y", ["g"]).collect()}
    assert got["a"] == (None, 2) and got["b"][1] == 3 and got["b"][0] == pytest.approx(-1.0)
    assert N.stable_areas(spark.createDataFrame([(60,), (49,), (None,)], "n_edges int")).agg(F.count("*")).first()[0] == 1
